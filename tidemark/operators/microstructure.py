"""Order-book and tape features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_flow(quotes: DataFrame) -> DataFrame:
    """Adds ofi: level-one order-flow imbalance against the quote before; 0 for the first.

    quotes: symbol, t, bid, bid_size, ask, ask_size. A higher bid adds its whole size, an equal one the change, a
    lower one takes away the size before; asks mirror that.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    b0, q0, a0, s0 = (F.lag(c).over(w) for c in ("bid", "bid_size", "ask", "ask_size"))
    b, q, a, s = (F.col(c) for c in ("bid", "bid_size", "ask", "ask_size"))
    bid = F.when(b > b0, q).when(b == b0, q - q0).otherwise(-q0)
    ask = F.when(a > a0, -s0).when(a == a0, s - s0).otherwise(s)
    ok = b0.isNotNull() & (F.least(b0, a0, b, a) > 0)
    return quotes.withColumn("ofi", F.when(ok, bid - ask).otherwise(0.0))


def top_of_book(book: DataFrame, depth: int = 5) -> DataFrame:
    """snap, bid, bid_size, ask, ask_size, mid, spread_bps, queue_imbalance from levels (snap, side, price, size)."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    k = F.row_number().over(Window.partitionBy("snap", "side").orderBy(F.when(bid, -F.col("price")).otherwise(F.col("price"))))
    near = book.withColumn("k", k).where(F.col("k") <= depth)
    g = near.groupBy("snap").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"), F.max(F.when(bid & (F.col("k") == 1), F.col("size"))).alias("bid_size"),
        F.min(F.when(ask, F.col("price"))).alias("ask"), F.max(F.when(ask & (F.col("k") == 1), F.col("size"))).alias("ask_size"),
        F.coalesce(F.sum(F.when(bid, F.col("size"))), F.lit(0.0)).alias("qb"), F.coalesce(F.sum(F.when(ask, F.col("size"))), F.lit(0.0)).alias("qa"),
    )
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    mid = (F.col("bid") + F.col("ask")) / 2
    return g.select(
        "snap", "bid", "bid_size", "ask", "ask_size", F.when(both, mid).otherwise(0.0).alias("mid"),
        F.when(both, (F.col("ask") - F.col("bid")) / mid * 1e4).otherwise(0.0).alias("spread_bps"),
        F.when(F.col("qb") + F.col("qa") > 0, (F.col("qb") - F.col("qa")) / (F.col("qb") + F.col("qa"))).otherwise(0.0).alias("queue_imbalance"))


def toxicity(markout_bps: Column, spread_bps: Column) -> Column:
    """0 to 1: adverse markout and a wide spread."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(F.lit(1.0), F.greatest(zero, -markout_bps) / 10 + F.greatest(zero, spread_bps - 2) / 20))


def minute_history(snapshots: DataFrame, every: int = 60) -> DataFrame:
    """One row for each symbol and `every` seconds: means of the features, the last mid, how many."""
    last = F.max_by("mid", "t").alias("mid")
    means = [F.avg(c).alias(c) for c in ("ofi", "queue_imbalance", "trade_sign", "spread_bps")]
    return snapshots.groupBy("symbol", (F.floor(F.col("t") / every) * every).alias("t")).agg(last, *means, F.count("*").alias("n")).where("mid <> 0")
