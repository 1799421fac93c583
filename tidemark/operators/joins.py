"""Joins over time that hash on a key and a slice of time, so that none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced(df: DataFrame, low: Column, high: Column, width: int, name: str = "_slice") -> DataFrame:
    """A row for each slice of the width that [low, high] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, at: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of right whose at lies in [low, high] of a left row with equal keys. Right's keys and at must be named r_<key>, at.

    Left rows are dealt to the slices that their span touches, right rows to their own, so the join hashes on keys
    and slice; each pair meets in one slice only. Keep width near the usual span.
    """
    a = sliced(left.withColumn("_low", low).withColumn("_high", high), F.col("_low"), F.col("_high"), width)
    b = right.withColumn("r_slice", F.floor(F.col(at) / width))
    on = (a["_slice"] == b["r_slice"]) & (b[at] >= a["_low"]) & (b[at] <= a["_high"])
    for k in keys:
        on = on & (a[k] == b[f"r_{k}"])
    return a.join(b, on, how).drop("_slice", "r_slice", "_low", "_high", *[f"r_{k}" for k in keys])


def as_of_forward(df: DataFrame, after: int, value: str, keys: tuple[str, ...] = ("symbol",), at: str = "t", width: int | None = None) -> DataFrame:
    """Adds later_t and later_<value>: of the first row of the key at least `after` seconds on; of equal times, the least value.

    Without width, one sort of a key's rows: right where they fit a task. With width, rows and their
    targets are dealt to slices of that many seconds. A target takes the next row of its slice or, past its last, the
    first of the next slice that has rows; so a key with a large share of all rows is spread over many tasks.
    """
    slice_ = (lambda c: F.lit(0)) if width is None else (lambda c: F.floor(c / width))
    points = df.groupBy(*keys, at).agg(F.min(value).alias("_v")).select(*keys, F.col(at).alias("_at"), F.struct(F.col(at).alias("t"), F.col("_v").alias("v")).alias("_p"), slice_(F.col(at)).alias("_s"))
    ask = df.withColumn("_at", F.col(at) + after).withColumn("_s", slice_(F.col(at) + after)).withColumn("_p", F.lit(None).cast(points.schema["_p"].dataType)).withColumn("_ask", F.lit(0))
    both = ask.unionByName(points.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    # From the latest on, so that the frame grows by a row at a time; the other way round each row would read the rest.
    behind = Window.partitionBy(*keys, "_s").orderBy(F.desc("_at"), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_hit", F.last("_p", ignorenulls=True).over(behind)).where("_ask = 0").drop("_p", "_at", "_ask")
    if width is not None:
        heads = points.groupBy(*keys, "_s").agg(F.min("_p").alias("_head"))
        nxt = Window.partitionBy(*keys).orderBy("_s")  # a row for each slice
        heads = heads.withColumn("_next", F.lead("_head").over(nxt)).withColumn("_to", F.lead("_s").over(nxt))
        # targets past a slice's last row, or in a slice without rows, need the first row of a later slice: every
        # slice from one head to the next knows it
        far = F.when(F.col("_to").isNull(), F.sequence("_s", F.col("_s") + F.lit(-(-after // width) + 1))).otherwise(F.sequence("_s", F.col("_to") - 1))
        met = met.join(heads.select(*keys, F.explode(far).alias("_s"), "_next"), [*keys, "_s"], "left").withColumn("_hit", F.coalesce("_hit", "_next"))
    return met.withColumn("later_t", F.col("_hit.t")).withColumn(f"later_{value}", F.col("_hit.v")).select(*df.columns, "later_t", f"later_{value}")


def running_sum(df: DataFrame, value: Column, name: str, keys: tuple[str, ...], order: tuple[str, ...], width: int) -> DataFrame:
    """Adds the running sum of value along order (the first a time) within keys, of a key as large as may be.

    Sums of slices of `width` seconds come first; a slice starts at the sum of those before it, and its rows add up
    in a task of their own. The window over whole keys sees a row for each slice only.
    """
    df = df.withColumn("_s", F.floor(F.col(order[0]) / width)).withColumn("_x", value)
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_s").agg(F.sum("_x").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [*keys, "_s"]).withColumn(name, F.col("_start") + F.sum("_x").over(within)).drop("_s", "_x", "_start")


def as_of_backward(left: DataFrame, right: DataFrame, value: str, keys: tuple[str, ...] = ("symbol",), at: str = "t") -> DataFrame:
    """Adds value of the last right row at or before each left row of the key: one sort of both sides together."""
    a = left.withColumn("_right", F.lit(0)).withColumn(f"_{value}", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*keys, at, F.col(value).alias(f"_{value}"), F.lit(-1).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy(at, "_right").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(f"_{value}", ignorenulls=True).over(seen)).where("_right = 0").drop("_right", f"_{value}")


def nearest_before(df: DataFrame, back: int, tolerance: int, value: str = "close", keys: tuple[str, ...] = ("symbol",), at: str = "t") -> DataFrame:
    """Adds was: the value of the row nearest to `back` seconds before, within the tolerance; of two, the earlier."""
    by = Window.partitionBy(*keys).orderBy(at)
    until, since = by.rangeBetween(-back - tolerance, -back), by.rangeBetween(-back, -back + tolerance)
    target = F.col(at) - back
    early, late = F.last(F.struct(at, value)).over(until), F.first(F.struct(at, value)).over(since)
    df = df.withColumn("_e", early).withColumn("_l", late)
    take_early = F.col("_l").isNull() | (F.col("_e").isNotNull() & ((target - F.col(f"_e.{at}")) <= (F.col(f"_l.{at}") - target)))
    return df.withColumn("was", F.when(take_early, F.col(f"_e.{value}")).otherwise(F.col(f"_l.{value}"))).drop("_e", "_l")


def first_touch(signals: DataFrame, bars: DataFrame, horizon: int, width: int, both: str = "AMBIGU") -> DataFrame:
    """outcome of each signal over later bars within the horizon: which of take_profit, stop_loss a bar touches first.

    signals: signal_id, symbol, t, side, entry, stop_loss, take_profit; bars: symbol, t, high, low, close.
    A bar that touches both gives `both` ('AMBIGU', or 'SL TOUCHÉ' for the cautious reading). Without a touch the last
    close tells whether it runs at a gain. checked counts the bars looked at.
    """
    path = bars.select(F.col("symbol").alias("r_symbol"), F.col("t").alias("bar_t"), "high", "low", "close")
    met = range_join(signals, path, ["symbol"], F.col("t") + 1, F.col("t") + horizon, "bar_t", width)
    long = F.col("side") == "LONG"
    tp = F.when(long, F.col("high") >= F.col("take_profit")).otherwise(F.col("low") <= F.col("take_profit"))
    sl = F.when(long, F.col("low") <= F.col("stop_loss")).otherwise(F.col("high") >= F.col("stop_loss"))
    hit = F.when(tp & sl, both).when(tp, "TP TOUCHÉ").when(sl, "SL TOUCHÉ")
    looked = met.withColumn("hit", hit).groupBy("signal_id").agg(
        F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("bar_t"))).alias("hit"), F.min(F.when(F.col("hit").isNotNull(), F.col("bar_t"))).alias("hit_t"),
        F.max_by("close", "bar_t").alias("last_close"), F.count("*").alias("checked"), F.max("high").alias("top"), F.min("low").alias("bottom"),
    )
    gain = (F.col("last_close") - F.col("entry")) * F.when(long, 1).otherwise(-1)
    running = F.when(gain > 0, "EN COURS +").when(gain < 0, "EN COURS -").otherwise("EN COURS")
    return signals.join(looked, "signal_id", "left").withColumn("outcome", F.coalesce("hit", running)).withColumn("checked", F.coalesce("checked", F.lit(0)).cast("bigint")).drop("hit")


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; a row_number filter, so Spark prunes before it shuffles."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def without(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def similar_sets(df: DataFrame, asked: Column, least: float, top: int, key: str = "event_id", tokens: str = "tokens") -> DataFrame:
    """query_<key>, <key>, similarity: for rows where asked holds, the top others by Jaccard, smaller keys first.

    Rows with one set of tokens are one class that keeps its top + 1 least keys, as no more can be reported; classes
    meet by the tokens they share. So the work goes by distinct sets, not by pairs of rows.
    """
    from ..functions.scalars import jaccard

    few = df.select(key, F.sort_array(F.array_distinct(tokens)).alias("set"))
    k = F.row_number().over(Window.partitionBy("set").orderBy(key))
    ids = few.withColumn("k", k).where(F.col("k") <= top + 1).groupBy("set").agg(F.collect_list(key).alias("ids"))
    queries = df.where(asked).select(F.col(key).alias(f"query_{key}"), F.sort_array(F.array_distinct(tokens)).alias("qset"))
    a = queries.select("qset").distinct().select("qset", F.explode("qset").alias("token"))
    pairs = a.join(ids.select("set", F.explode("set").alias("token")), "token").select("qset", "set").distinct()
    near = pairs.withColumn("similarity", jaccard(F.col("qset"), F.col("set"))).where(F.col("similarity") >= least).join(ids, "set")
    best = Window.partitionBy(f"query_{key}").orderBy(F.desc("similarity"), key)
    out = queries.join(near, "qset").select(f"query_{key}", "similarity", F.explode("ids").alias(key)).where(F.col(key) != F.col(f"query_{key}"))
    return out.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).drop("k")
