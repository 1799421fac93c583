"""The carrier views that the queries run on, in Spark and as DuckDB common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SECONDS = 21_600


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """event_id, sec (epoch), user_id, event_type, value, props."""
        sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        return self.table("events").select("event_id", sec.alias("sec"), "user_id", "event_type", "value", "props")

    @property
    def bars(self) -> DataFrame:
        """symbol, t, rn, open, high, low, close, volume: six-hour bars of each event type."""
        first = F.struct("sec", "event_id")
        out = (
            self.events.groupBy(F.col("event_type").alias("symbol"), (F.floor(F.col("sec") / BAR_SECONDS) * BAR_SECONDS).cast("bigint").alias("t"))
            .agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.count("*").cast("double").alias("volume"))
        )
        return out.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("t")).cast("bigint"))

    @property
    def walk(self) -> DataFrame:
        """Bars whose middle wanders: price moves by what each bar closed off 50, so that gaps and trends occur."""
        by = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        mid = F.round(500 + F.sum((F.col("close") - 50) / 10).over(by), 6)
        c = F.col
        return self.bars.withColumn("mid", mid).select(
            "symbol", "t", "rn", F.round(c("mid") - (c("close") - c("open")) / 40, 6).alias("open"), F.round(c("mid") + (c("high") - c("close")) / 60, 6).alias("high"), F.round(c("mid") - (c("close") - c("low")) / 60, 6).alias("low"), c("mid").alias("close"), "volume")

    @property
    def tape(self) -> DataFrame:
        """symbol, t, event_id, side, size, price."""
        return self.events.select(F.col("event_type").alias("symbol"), F.col("sec").alias("t"), "event_id", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("value").alias("size"), (F.lit(100.0) + F.col("user_id") % 50).alias("price"))

    @property
    def book(self) -> DataFrame:
        """snap, side, price, size: a two-sided book for each order; equal prices of a side add up."""
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("snap"), F.when(F.col("l_linenumber") % 2 == 1, "bid").otherwise("ask").alias("side"), (F.floor(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double") * 100) / 100.0 + F.when(F.col("l_linenumber") % 2 == 1, 0.0).otherwise(2000.0)).alias("price"), F.col("l_quantity").cast("double").alias("size"))
            .groupBy("snap", "side", "price").agg(F.sum("size").alias("size"))
        )

    @property
    def signals(self) -> DataFrame:
        """One signal per bar: signal_id, symbol, t, rn, side, entry, risk, stop_loss, take_profit."""
        risk = F.round(0.1 * F.col("close"), 6)
        long = F.col("rn") % 2 == 0
        return self.bars.select(
            F.concat_ws("|", F.col("symbol"), F.col("t").cast("string")).alias("signal_id"), "symbol", "t", "rn", F.when(long, "LONG").otherwise("SHORT").alias("side"), F.col("close").alias("entry"), risk.alias("risk"),
            F.round(F.col("close") + F.when(long, -1.0).otherwise(1.0) * risk, 6).alias("stop_loss"), F.round(F.col("close") + F.when(long, 2.0).otherwise(-2.0) * risk, 6).alias("take_profit"),
        )

    @property
    def votes(self) -> DataFrame:
        """symbol, t, agent, vote, confidence, price: one vote of each agent (event type) for each user group and day."""
        return (
            self.events.groupBy(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), (F.floor(F.col("sec") / 86400) * 86400).cast("bigint").alias("t"), F.col("event_type").alias("agent"))
            .agg(F.round(F.avg("value"), 6).alias("m"), F.count("*").alias("n"))
            .withColumn("vote", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("m") - 50) / 50)), 6))
            .withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 4.0), 6))
            .withColumn("price", F.round(F.avg("m").over(Window.partitionBy("symbol", "t")), 6))
            .select("symbol", "t", "agent", "vote", "confidence", "price")
        )

    @property
    def venues(self) -> DataFrame:
        """exchange, mark, oi_usd, funding: a venue for each region."""
        orders, cust, nation, region = self.table("orders"), self.table("customer"), self.table("nation"), self.table("region")
        by = cust.join(nation, cust.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("c_custkey", "r_name")
        keyed = orders.join(by, orders.o_custkey == by.c_custkey).select("o_orderkey", "r_name", "o_totalprice")
        marks = keyed.groupBy("r_name").agg(F.round(F.avg("o_totalprice"), 6).alias("mark"), F.round(F.sum("o_totalprice"), 2).alias("oi_usd"))
        fund = self.table("lineitem").join(keyed.select("o_orderkey", "r_name"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name").agg(F.round(F.avg(F.col("l_discount") - F.col("l_tax")) / 100, 9).alias("funding"))
        return marks.join(fund, "r_name").select(F.col("r_name").alias("exchange"), "mark", "oi_usd", "funding")

    @property
    def fills(self) -> DataFrame:
        """order_id, line, c_time (ms), side, size, amount, fee_coin, fee, profit: fills of orders."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000).alias("c_time"),
            F.when(F.col("l_linenumber") <= 4, "buy").otherwise("sell").alias("side"), F.col("l_quantity").cast("double").alias("size"), F.col("l_extendedprice").cast("double").alias("amount"),
            F.when(F.col("l_linenumber") % 3 == 0, "BTC").otherwise("USDT").alias("fee_coin"), F.round(F.col("l_tax") * F.col("l_extendedprice") / 100, 6).cast("double").alias("fee"),
            F.round((F.col("l_discount") - 0.05) * F.col("l_extendedprice"), 4).cast("double").alias("profit"),
        )

    @property
    def journal(self) -> DataFrame:
        """Signals journal: symbol, t, status, rsi, ranking, implied_leverage (strings, blanks kept)."""
        return self.events.select(
            F.col("event_type").alias("symbol"), F.col("sec").alias("t"), "event_id", F.when(F.col("user_id") % 3 == 0, "REFUSÉ").otherwise("ACCEPTÉ").alias("status"),
            F.when(F.col("event_id") % 10 == 0, "").otherwise(F.round("value", 2).cast("string")).alias("rsi"),
            F.when(F.col("event_id") % 7 == 0, "").otherwise((F.col("event_id") % 9 - 2).cast("string")).alias("ranking"), (F.col("user_id") % 30 / 10.0).alias("implied_leverage"),
        )


# The same views as DuckDB common table expressions.
EV = "ev AS (SELECT event_id, floor(epoch(ts))::BIGINT AS sec, user_id, event_type, value, props FROM events)"
BARS = EV + """, bars0 AS (SELECT event_type AS symbol, (sec // 21600) * 21600 AS t, first(value ORDER BY sec, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY sec, event_id) AS close, count(*)::DOUBLE AS volume FROM ev GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM bars0)"""
WALK = BARS + """, walk0 AS (SELECT *, round(500 + sum((close - 50) / 10) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS mid FROM bars),
walk AS (SELECT symbol, t, rn, round(mid - (close - open) / 40, 6) AS open, round(mid + (high - close) / 60, 6) AS high, round(mid - (close - low) / 60, 6) AS low, mid AS close, volume FROM walk0)"""
TAPE = EV + ", tape AS (SELECT event_type AS symbol, sec AS t, event_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, value AS size, 100.0::DOUBLE + user_id % 50 AS price FROM ev)"
BOOK = """book AS (SELECT l_orderkey AS snap, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
  (floor(l_extendedprice::DOUBLE / l_quantity::DOUBLE * 100) / 100.0::DOUBLE + CASE WHEN l_linenumber % 2 = 1 THEN 0.0 ELSE 2000.0 END)::DOUBLE AS price, sum(l_quantity::DOUBLE) AS size FROM lineitem GROUP BY 1, 2, 3)"""
SIGNALS = BARS + """, signals AS (SELECT symbol || '|' || t AS signal_id, symbol, t, rn, CASE WHEN rn % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, close AS entry, round(0.1 * close, 6) AS risk,
  round(close + CASE WHEN rn % 2 = 0 THEN -1.0 ELSE 1.0 END * round(0.1 * close, 6), 6) AS stop_loss, round(close + CASE WHEN rn % 2 = 0 THEN 2.0 ELSE -2.0 END * round(0.1 * close, 6), 6) AS take_profit FROM bars)"""
VOTES = EV + """, votes0 AS (SELECT 'S' || (user_id % 8) AS symbol, (sec // 86400) * 86400 AS t, event_type AS agent, round(avg(value), 6) AS m, count(*) AS n FROM ev GROUP BY 1, 2, 3),
votes AS (SELECT symbol, t, agent, round(greatest(-1.0, least(1.0, (m - 50) / 50)), 6) AS vote, round(least(1.0, n / 4.0), 6) AS confidence, round(avg(m) OVER (PARTITION BY symbol, t), 6) AS price FROM votes0)"""
VENUES = """keyed AS (SELECT o_orderkey, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
venues AS (SELECT a.r_name AS exchange, mark, oi_usd, funding FROM (SELECT r_name, round(avg(o_totalprice), 6) AS mark, round(sum(o_totalprice), 2) AS oi_usd FROM keyed GROUP BY 1) a
  JOIN (SELECT r_name, round(avg(l_discount - l_tax) / 100, 9) AS funding FROM lineitem JOIN keyed ON l_orderkey = o_orderkey GROUP BY 1) b USING (r_name))"""
FILLS = """fills AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT * 86400000 AS c_time, CASE WHEN l_linenumber <= 4 THEN 'buy' ELSE 'sell' END AS side,
  l_quantity::DOUBLE AS size, l_extendedprice::DOUBLE AS amount, CASE WHEN l_linenumber % 3 = 0 THEN 'BTC' ELSE 'USDT' END AS fee_coin, round(l_tax * l_extendedprice / 100, 6)::DOUBLE AS fee,
  round((l_discount - 0.05) * l_extendedprice, 4)::DOUBLE AS profit FROM lineitem)"""
JOURNAL = EV + """, journal AS (SELECT event_type AS symbol, sec AS t, event_id, CASE WHEN user_id % 3 = 0 THEN 'REFUSÉ' ELSE 'ACCEPTÉ' END AS status, CASE WHEN event_id % 10 = 0 THEN '' ELSE round(value, 2)::VARCHAR END AS rsi,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE (event_id % 9 - 2)::VARCHAR END AS ranking, user_id % 30 / 10.0::DOUBLE AS implied_leverage FROM ev)"""
