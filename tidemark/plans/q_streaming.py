"""Streaming queries, run through the events once and read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..streaming import features as S
from .registry import query
from .views import TAPE


def _folder(v) -> str:
    return f"{shared_folder(v.spark)}/tidemark/stream-{uuid.uuid4().hex}"


def _tape(v):
    schema = v.table("events").schema
    return S.tape_stream(v.spark, f"{v.folder}/events.parquet*", schema)


@query("r1_windowed_flow", "WITH " + TAPE + " SELECT symbol, (t // 3600) * 3600 AS start, count(*) AS n, round(sum(CASE side WHEN 'buy' THEN size ELSE 0 END), 4) AS buy, round(sum(CASE side WHEN 'sell' THEN size ELSE 0 END), 4) AS sell FROM tape GROUP BY 1, 2")
def _(v):
    """Complete hourly windows: the last ones are flushed by the end of the input in complete mode."""
    at = _folder(v)
    name = "flow_" + uuid.uuid4().hex
    q = S.windowed_flow(_tape(v), "1 hour", "1 day").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", at + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.table(name).select("symbol", F.unix_seconds("start").alias("start"), "n", F.round("buy", 4).alias("buy"), F.round("sell", 4).alias("sell"))


ORDER_FLOW = f"""WITH {TAPE}, q AS (SELECT symbol, (t // 3600) * 3600 + 3600 AS e, avg(price) FILTER (WHERE side = 'buy') AS b, sum(size) FILTER (WHERE side = 'buy') AS bs, avg(price) FILTER (WHERE side = 'sell') AS a, sum(size) FILTER (WHERE side = 'sell') AS s FROM tape GROUP BY 1, 2),
o AS (SELECT * FROM q WHERE b IS NOT NULL AND a IS NOT NULL AND e <= (SELECT epoch(max(ts)) - 86400 FROM events)),
l AS (SELECT *, lag(b) OVER w AS b0, lag(bs) OVER w AS bs0, lag(a) OVER w AS a0, lag(s) OVER w AS s0 FROM o WINDOW w AS (PARTITION BY symbol ORDER BY e))
SELECT symbol, e AS t, round(CASE WHEN b0 IS NULL OR least(b0, a0, b, a) <= 0 THEN 0 ELSE CASE WHEN b > b0 THEN bs WHEN b = b0 THEN bs - bs0 ELSE -bs0 END - CASE WHEN a > a0 THEN -s0 WHEN a = a0 THEN s - s0 ELSE s END END, 4)::DOUBLE AS ofi FROM l"""


@query("r2_order_flow_state", ORDER_FLOW)
def _(v):
    """Quotes by window are a table of their own; a second stream folds them, as state can't follow an aggregation."""
    at = _folder(v)
    S.run_to_table(S.quotes(_tape(v), "1 hour", "1 day"), at + "/quotes", at + "/cp1")
    S.run_to_table(S.order_flow(v.spark.readStream.schema(S.QUOTES).parquet(at + "/quotes")), at + "/out", at + "/cp")
    return v.spark.read.schema(S.FLOW).parquet(at + "/out").select("symbol", F.unix_seconds("ts").alias("t"), F.round("ofi", 4).alias("ofi"))


@query("r6_throttled", "WITH " + TAPE + " SELECT symbol, count(DISTINCT t // 3600) AS n FROM tape GROUP BY 1")
def _(v):
    at = _folder(v)
    S.run_to_table(S.throttled(_tape(v), "symbol", "1 hour", "400 days"), at + "/out", at + "/cp")
    rows = v.spark.read.schema("symbol string, ts timestamp, event_id long, side string, size double, price double").parquet(at + "/out")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"))


@query("r7_changed_rows", "WITH " + TAPE + ", a AS (SELECT symbol, count(*) FILTER (WHERE event_id % 10 <> 0) AS b, count(*) AS n FROM tape GROUP BY 1) SELECT symbol, n FROM a WHERE n <> b")
def _(v):
    before = v.tape.where("event_id % 10 <> 0").groupBy("symbol").agg(F.count("*").alias("n"))
    after = v.tape.groupBy("symbol").agg(F.count("*").alias("n"))
    return S.changed(before, after, "symbol", ["n"]).select("symbol", "n")


@query(
    "r3_rolling_buffer",
    "WITH " + TAPE + " SELECT symbol, event_id, t FROM tape QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, event_id DESC) <= 600",
)
def _(v):
    """The last 600 trades of each symbol, kept up batch by batch."""
    at = _folder(v)
    tape = _tape(v).select("symbol", "event_id", F.unix_seconds("ts").alias("t"))
    S.rolling_buffer(tape, at + "/buffer", at + "/cp", ["symbol"], ["t", "event_id"], "event_id", 600)
    return v.spark.read.schema("symbol string, event_id bigint, t bigint").parquet(at + "/buffer")


@query(
    "r8_sessions",
    """WITH x AS (SELECT event_type AS symbol, ts, value, epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
y AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT symbol, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS size FROM y GROUP BY symbol, k""",
)
def _(v):
    """Bursts of trades: a session ends where two hours pass without one."""
    at, name = _folder(v), "sessions_" + uuid.uuid4().hex
    s = S.sessions(_tape(v), "2 hours", "400 days")
    q = s.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", at + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.table(name).select("symbol", F.unix_seconds("start").alias("start"), "n", F.round("size", 4).alias("size"))
