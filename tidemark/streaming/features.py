"""Order-flow features and journals as Structured Streaming: event time, watermarks, state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files

QUOTES = "symbol string, ts timestamp, bid double, bid_size double, ask double, ask_size double"


def tape_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 10) -> DataFrame:
    """Files of trades as they come: symbol, ts, event_id, side, size, price. ts becomes a zoned timestamp, as watermarks ask for."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    side = F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", side.alias("side"), F.col("value").alias("size"), (F.lit(100.0) + F.col("user_id") % 50).alias("price"))


def windowed_flow(tape: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """One row for each symbol and tumbling window: trades, sizes by side, signed flow, last price."""
    buy = F.when(F.col("side") == "buy", F.col("size")).otherwise(0.0)
    sell = F.when(F.col("side") == "sell", F.col("size")).otherwise(0.0)
    return (
        tape.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(buy).alias("buy"), F.sum(sell).alias("sell"), F.max_by("price", "ts").alias("last"))
        .select("symbol", F.col("w.start").alias("start"), "n", "buy", "sell", ((F.col("buy") - F.col("sell")) / (F.col("buy") + F.col("sell"))).alias("trade_sign"), "last")
    )


def sessions(tape: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row for each symbol and burst of trades without a pause of gap: start, trades, size."""
    return (
        tape.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("symbol", F.col("w.start").alias("start"), "n", "size")
    )


def rolling_buffer(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], identity: str, most: int) -> None:
    """Keep the last rows of each key in a table at path, most at most, from all that has come.

    Each batch is joined to what the table holds and swapped in whole, so readers see one state or the next. A batch
    that is run again after a failure changes nothing, as rows count once by identity.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if files.exists(spark, path):
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(path)).dropDuplicates([identity])
        files.swap(files.retain(rows, keys, [F.desc(c) for c in order], most), path)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quotes(tape: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Mean price and size of each side by window, as quotes for the order-flow state."""
    buy = F.col("side") == "buy"
    q = tape.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.avg(F.when(buy, F.col("price"))).alias("bid"), F.sum(F.when(buy, F.col("size"))).alias("bid_size"), F.avg(F.when(~buy, F.col("price"))).alias("ask"), F.sum(F.when(~buy, F.col("size"))).alias("ask_size"))
    return q.where("bid is not null and ask is not null").select("symbol", F.col("w.end").alias("ts"), "bid", "bid_size", "ask", "ask_size")


def flow_step(was: tuple | None, now: tuple) -> float:
    """Level-one order-flow imbalance of (bid, bid size, ask, ask size) against the quote before."""
    if was is None or min(was[0], was[2], now[0], now[2]) <= 0:
        return 0.0
    b0, q0, a0, s0 = was
    b, q, a, s = now
    return (q if b > b0 else q - q0 if b == b0 else -q0) - (-s0 if a > a0 else s - s0 if a == a0 else s)


FLOW = "symbol string, ts timestamp, ofi double"
FLOW_STATE = "ts timestamp, bid double, bid_size double, ask double, ask_size double"


def _flow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    was, since = None, None
    if state.exists:
        since, *old = state.get
        was = tuple(old)
    out = []
    for r in rows.itertuples(index=False):
        if since is not None and r.ts <= since:
            continue  # older than what the state has seen: never counted twice
        now = (r.bid, r.bid_size, r.ask, r.ask_size)
        out.append((key[0], r.ts, flow_step(was, now)))
        was, since = now, r.ts
    if was is not None:
        state.update((since, *was))
    yield pd.DataFrame(out, columns=["symbol", "ts", "ofi"])


def order_flow(quote_stream: DataFrame) -> DataFrame:
    """ofi of each quote against the symbol's quote before it, kept in checkpointed state."""
    return quote_stream.groupBy("symbol").applyInPandasWithState(_flow, FLOW, FLOW_STATE, "append", GroupStateTimeout.NoTimeout)


def throttled(stream: DataFrame, key: str, every: str, late: str = "10 minutes") -> DataFrame:
    """One row of each key and slice of time at most, over restarts too."""
    sliced = stream.withColumn("_slice", F.window("ts", every)["start"]).withWatermark("ts", late)
    return sliced.dropDuplicatesWithinWatermark([key, "_slice"]).drop("_slice")


def fresh(df: DataFrame, at: Column, now: Column, most_seconds: int) -> DataFrame:
    """Rows not older than so many seconds: a guard, apart from watermarks."""
    return df.where((now.cast("long") - at.cast("long")).between(0, most_seconds))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of after whose content is new or differs, with a mark of it: what a reader with `before` still lacks."""
    mark = lambda d: F.substring(F.md5(F.to_json(F.struct(*[d[c] for c in columns]))), 1, 12)
    a = after.select(key, *columns, mark(after).alias("mark"))
    b = before.select(before[key].alias("_k"), mark(before).alias("_m"))
    return a.join(b, (a[key] == b["_k"]) & (a["mark"] == b["_m"]), "left_anti")


def push_changes(stream: DataFrame, key: str, columns: list[str], path: str, checkpoint: str):
    """A query that writes each batch's rows beside their marks; a batch that is retried overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        marked = df.withColumn("mark", F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 12)).withColumn("batch", F.lit(batch))
        marked.dropDuplicates([key, "mark"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs through what there is, exactly once, into Parquet."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
