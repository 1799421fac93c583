"""Profiles of price, and models of liquidity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp


def close_profile(bars: DataFrame, bins: int = 24, share: float = 0.70) -> DataFrame:
    """symbol, poc, value_area_low, value_area_high, total_volume: volume by the bin of the close.

    The value area grows from the fullest bin (the first of equals) to the fuller neighbour, right on ties, until it
    holds the share. Volumes are summed by bin first, so the fold sees bins, not bars.
    """
    ends = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("close") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    by = bars.join(ends, "symbol").groupBy("symbol", "lo", "hi", bin_.cast("int").alias("bin")).agg(F.sum("volume").alias("volume"))

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi, total = float(g.lo.iloc[0]), float(g.hi.iloc[0]), float(g.volume.sum())
        held = [0.0] * bins
        for b, x in zip(g.bin, g.volume, strict=True):
            held[int(b)] = float(x)
        if hi == lo:
            return pd.DataFrame([(g.symbol.iloc[0], lo, lo, hi, total)])
        w = (hi - lo) / bins
        peak = held.index(max(held))
        a = z = peak
        got = held[peak]
        while got < share * sum(held) and (a > 0 or z < bins - 1):
            left, right = held[a - 1] if a > 0 else -1.0, held[z + 1] if z < bins - 1 else -1.0
            if right >= left:
                z += 1
                got += right
            else:
                a -= 1
                got += left
        mid = lambda k: round(lo + (k + 0.5) * w, 6)
        return pd.DataFrame([(g.symbol.iloc[0], mid(peak), mid(a), mid(z), total)])

    return by.groupBy("symbol").applyInPandas(grow, "symbol string, poc double, value_area_low double, value_area_high double, total_volume double")


def range_profile(bars: DataFrame, bins: int = 24, share: float = 0.70) -> DataFrame:
    """symbol, poc, tpo_poc, val, vah: each bar's volume (and time) spread over the bins it ranges over.

    The value area is the fullest bins to the share, not needing to touch; ties go to the lower bin.
    """
    ends = bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("hi > lo")
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("lo")) / F.col("width")).cast("int")))
    spread = bars.join(ends, "symbol").withColumn("width", (F.col("hi") - F.col("lo")) / bins).withColumn("a", at("low")).withColumn("z", at("high"))
    n = F.col("z") - F.col("a") + 1
    g = (
        spread.select("symbol", "lo", "width", (F.col("volume") / n).alias("v"), (1.0 / n).alias("t"), F.explode(F.sequence("a", "z")).alias("bin"))
        .groupBy("symbol", "lo", "width", "bin").agg(F.round(F.sum("v"), 6).alias("v"), F.round(F.sum("t"), 6).alias("t"))
    )
    order = Window.partitionBy("symbol").orderBy(F.desc("v"), "bin").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("inside", F.sum("v").over(order) - F.col("v") < share * F.sum("v").over(Window.partitionBy("symbol")))
    edge = lambda k: F.col("lo") + (F.col("bin") + k) * F.col("width")
    return g.groupBy("symbol").agg(
        F.round(F.max_by(edge(0.5), F.struct("v", -F.col("bin"))), 4).alias("poc"), F.round(F.max_by(edge(0.5), F.struct("t", -F.col("bin"))), 4).alias("tpo_poc"),
        F.round(F.min(F.when(F.col("inside"), edge(0))), 4).alias("val"), F.round(F.max(F.when(F.col("inside"), edge(1))), 4).alias("vah"))


def liquidation_levels(venues: DataFrame, tiers: list[tuple[float, float]]) -> DataFrame:
    """Where longs (below) and shorts (above) of each leverage tier are liquidated, and how much by open interest."""
    longs = clamp(0.5 + F.col("funding") * 500, 0.2, 0.8)
    kinds = F.array(*[F.struct(F.lit(float(l)).alias("leverage"), F.lit(float(s)).alias("share"), F.lit(side).alias("side")) for l, s in tiers for side in ("long", "short")])
    df = venues.withColumn("k", F.explode(kinds)).select("exchange", "mark", "oi_usd", longs.alias("ls"), "k.*")
    way = F.when(F.col("side") == "long", -1).otherwise(1)
    return df.select(
        "exchange", "side", "leverage", F.round(F.col("mark") * (1 + way / F.col("leverage")), 2).alias("price"), F.round(way / F.col("leverage") * 100, 2).alias("distance_pct"),
        (F.col("oi_usd") * F.col("share") * F.when(F.col("side") == "long", F.col("ls")).otherwise(1 - F.col("ls"))).alias("notional"))


def liquidation_skew(levels: DataFrame, band: float = 8.0) -> DataFrame:
    """net: pools above less pools below, nearer ones weighing more; 0 without any in the band."""
    w = F.col("notional") / (1 + F.abs("distance_pct"))
    signed = F.when(F.col("side") == "short", w).otherwise(-w)
    return levels.where(F.abs("distance_pct") <= band).groupBy("exchange").agg(F.round(F.sum(signed) / F.sum(w), 6).alias("net"))


def cluster_map(levels: DataFrame, bucket: float = 1.0, top: int = 8) -> DataFrame:
    """The fullest buckets of distance; half a bucket rounds to the even one."""
    df = levels.groupBy("exchange", (F.bround(F.col("distance_pct") / bucket, 0) * bucket).alias("bucket_pct")).agg(F.round(F.sum("notional"), 2).alias("notional"))
    k = F.row_number().over(Window.partitionBy("exchange").orderBy(F.desc("notional"), "bucket_pct"))
    return df.withColumn("k", k).where(F.col("k") <= top).drop("k")


def book_imbalance(book: DataFrame, depth: int = 5) -> DataFrame:
    """(bid - ask) / (bid + ask) of the sizes of the best levels of each side."""
    best = F.row_number().over(Window.partitionBy("snap", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))))
    near = book.withColumn("k", best).where(F.col("k") <= depth)
    signed = F.when(F.col("side") == "bid", F.col("size")).otherwise(-F.col("size"))
    return near.groupBy("snap").agg(F.round(F.sum(signed) / F.sum("size"), 6).alias("imbalance"))
