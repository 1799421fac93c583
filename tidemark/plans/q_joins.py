"""Joins over time, sorts, top-k and order-dependent matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as P
from ..operators import joins as J
from ..operators import windows as W
from .registry import query
from .views import BARS, EV, FILLS, JOURNAL, SIGNALS, TAPE, VENUES, VOTES, WALK

B = "WITH " + BARS
S = "WITH " + SIGNALS
SIX_DAYS = 6 * 86400


@query("j1_daily_inner_left", B + ", d AS (SELECT symbol, t // 86400 AS day, arg_max(close, t) AS close FROM bars GROUP BY ALL) SELECT a.day, round(a.close, 6) AS price, round(b.close, 6) AS hashrate, round(c.close, 6) AS fear FROM d a JOIN d b ON a.day = b.day AND b.symbol = 'view' LEFT JOIN d c ON a.day = c.day AND c.symbol = 'signup' WHERE a.symbol = 'click'")
def _(v):
    day = v.bars.groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.max_by("close", "t").alias("close"))
    one = lambda s, n: day.where(F.col("symbol") == s).select("day", F.round("close", 6).alias(n))
    return one("click", "price").join(one("view", "hashrate"), "day").join(one("signup", "fear"), "day", "left")


FORWARD = "WITH " + EV + """, first AS (SELECT event_type, sec, arg_min(value, event_id) AS value FROM ev GROUP BY 1, 2),
asked AS (SELECT event_id, event_type, sec + 3600 AS due FROM ev)
SELECT a.event_id, b.sec AS later_t, b.value AS later_value FROM asked a ASOF LEFT JOIN first b ON a.event_type = b.event_type AND a.due <= b.sec"""


@query("j2_forward_as_of", FORWARD)
def _(v):
    ev = v.events.withColumnsRenamed({"event_type": "symbol", "sec": "t"})
    ev = ev.withColumn("row", F.struct("event_id", "value"))  # of equal times, the least event_id
    return J.as_of_forward(ev, 3600, "row", width=86_400).select("event_id", "later_t", F.col("later_row.value").alias("later_value"))


@query("j2_live_ic_pairs", "WITH " + VOTES + ", p AS (SELECT a.symbol, a.t, a.agent, a.vote, a.price, min(b.t) AS lt FROM votes a LEFT JOIN votes b ON a.symbol = b.symbol AND b.t >= a.t + 86400 GROUP BY ALL) SELECT p.symbol, p.t, p.agent, p.vote, round(ln(min(b.price) / p.price), 6) AS fwd FROM p JOIN votes b ON b.symbol = p.symbol AND b.t = p.lt GROUP BY p.symbol, p.t, p.agent, p.vote, p.price")
def _(v):
    prices = v.votes.select("symbol", "t", "price").distinct()
    ahead = J.as_of_forward(prices, 86400, "price").where("later_price is not null")
    return v.votes.join(ahead.select("symbol", "t", "later_price"), ["symbol", "t"]).select("symbol", "t", "agent", "vote", F.round(F.log(F.col("later_price") / F.col("price")), 6).alias("fwd"))


@query("j3_offset_self_join", B + " SELECT a.symbol, a.t, round(b.close / a.close - 1, 6) AS fwd FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.rn = a.rn + 8")
def _(v):
    return v.bars.select("symbol", "t", F.round(F.try_divide(W.lead("close", 8), "close") - 1, 6).alias("fwd")).where("fwd is not null")


def touch_sql(both: str) -> str:
    return S + f""", m AS (SELECT s.*, b.t AS bt, b.close, CASE WHEN side = 'LONG' THEN b.high >= take_profit ELSE b.low <= take_profit END AS tp, CASE WHEN side = 'LONG' THEN b.low <= stop_loss ELSE b.high >= stop_loss END AS sl FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.t > s.t AND b.t <= s.t + {SIX_DAYS}),
h AS (SELECT signal_id, arg_min(CASE WHEN tp AND sl THEN '{both}' WHEN tp THEN 'TP TOUCHÉ' ELSE 'SL TOUCHÉ' END, bt) FILTER (WHERE tp OR sl) AS hit, min(bt) FILTER (WHERE tp OR sl) AS hit_t, arg_max(close, bt) AS last_close, count(*) AS checked FROM m GROUP BY 1),
o AS (SELECT s.signal_id, s.symbol, s.side, s.t, s.entry, s.stop_loss, s.take_profit, coalesce(hit, CASE WHEN (last_close - entry) * CASE WHEN side = 'LONG' THEN 1 ELSE -1 END > 0 THEN 'EN COURS +' WHEN (last_close - entry) * CASE WHEN side = 'LONG' THEN 1 ELSE -1 END < 0 THEN 'EN COURS -' ELSE 'EN COURS' END) AS outcome, hit_t, coalesce(checked, 0) AS checked FROM signals s LEFT JOIN h USING (signal_id))"""


def outcomes(v, both: str = "AMBIGU"):
    return J.first_touch(v.signals, v.bars, SIX_DAYS, SIX_DAYS, both)


@query("j4_first_touch", touch_sql("AMBIGU") + " SELECT signal_id, outcome, hit_t, checked FROM o")
def _(v):
    return outcomes(v).select("signal_id", "outcome", "hit_t", "checked")


@query("j4_first_touch_cautious", touch_sql("SL TOUCHÉ") + " SELECT signal_id, outcome, hit_t FROM o")
def _(v):
    return outcomes(v, "SL TOUCHÉ").select("signal_id", "outcome", "hit_t")


@query("j4_first_touch_long_only", touch_sql("AMBIGU") + " SELECT signal_id, outcome FROM o WHERE side = 'LONG' AND outcome IN ('TP TOUCHÉ', 'SL TOUCHÉ', 'AMBIGU')")
def _(v):
    return J.first_touch(v.signals.where("side = 'LONG'"), v.bars, SIX_DAYS, SIX_DAYS).where(F.col("outcome").isin("TP TOUCHÉ", "SL TOUCHÉ", "AMBIGU")).select("signal_id", "outcome")


@query("j5_window_slice", S + " SELECT signal_id, count(b.t)::BIGINT AS bars, round(max(b.high), 6) AS top, round(min(b.low), 6) AS bottom FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.t BETWEEN s.t AND s.t + 172800 GROUP BY 1")
def _(v):
    path = v.bars.select(F.col("symbol").alias("r_symbol"), F.col("t").alias("bar_t"), "high", "low")
    met = J.range_join(v.signals, path, ["symbol"], F.col("t"), F.col("t") + 172_800, "bar_t", 172_800)
    return met.groupBy("signal_id").agg(F.count("*").alias("bars"), F.round(F.max("high"), 6).alias("top"), F.round(F.min("low"), 6).alias("bottom"))


@query("j6_unfinished_signals", touch_sql("AMBIGU") + " SELECT signal_id, symbol, t FROM signals s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.signal_id = s.signal_id AND outcome IN ('TP TOUCHÉ', 'SL TOUCHÉ', 'AMBIGU'))")
def _(v):
    done = outcomes(v).where(F.col("outcome").isin("TP TOUCHÉ", "SL TOUCHÉ", "AMBIGU"))
    return J.without(v.signals, done, ["signal_id"]).select("signal_id", "symbol", "t")


@query("j7_same_side_open", touch_sql("AMBIGU") + " SELECT signal_id FROM signals s WHERE (symbol, side) NOT IN (SELECT symbol, side FROM o WHERE outcome LIKE 'EN COURS%' AND t > 1706000000)")
def _(v):
    live = outcomes(v).where("outcome like 'EN COURS%' and t > 1706000000")
    return J.without(v.signals, live, ["symbol", "side"]).select("signal_id")


GREEDY = "WITH RECURSIVE " + EV + """, e AS (SELECT event_type AS symbol, event_id, sec AS t, value AS amount, event_id % 3 = 0 AS buy FROM ev),
j AS (SELECT *, coalesce(t - lag(t) OVER w > 300, true)::INT AS jump FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t, event_id)),
g AS (SELECT *, sum(jump) OVER (PARTITION BY symbol ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, chain ORDER BY t, event_id) AS k FROM g WHERE buy),
r AS (SELECT DISTINCT symbol, chain, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS buy_id, NULL::BIGINT AS fill_id FROM b
  UNION ALL SELECT symbol, chain, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, buy_id, pick FROM (
    SELECT r.symbol, r.chain, b.k, r.used, b.event_id AS buy_id, arg_min(f.event_id, (abs(f.t - b.t), f.t, f.event_id)) AS pick FROM r JOIN b ON b.symbol = r.symbol AND b.chain = r.chain AND b.k = r.k + 1
      LEFT JOIN g f ON f.symbol = b.symbol AND f.chain = b.chain AND NOT f.buy AND abs(f.t - b.t) <= 300 AND (abs(f.amount - b.amount) <= 0.35 * b.amount OR b.amount <= 0) AND NOT list_contains(r.used, f.event_id) GROUP BY r.symbol, r.chain, b.k, r.used, b.event_id)),
first AS (SELECT symbol, min(t) - 300 AS since FROM b GROUP BY 1)
SELECT symbol, CASE WHEN fill_id IS NULL THEN 'buy' ELSE 'pair' END AS kind, buy_id, fill_id FROM r WHERE k > 0
UNION ALL SELECT g.symbol, 'fill', NULL, event_id FROM g JOIN first USING (symbol) WHERE NOT buy AND t >= since AND NOT EXISTS (SELECT 1 FROM r WHERE r.fill_id = g.event_id)"""


RUN_ROWS = 50_000


@query("j8_greedy_nearest_match", GREEDY)
def _(v):
    """Ledger buys against fills of the same customer group, nearest first. No pair spans a pause of over 300 s, so what
    lies between pauses is matched apart, some RUN_ROWS rows a task. Where a series never pauses, it is one task, which
    reads its rows in order and holds those of ten minutes."""
    ev = v.events.where("event_type is not null and event_id is not null").select(F.col("event_type").alias("symbol"), (F.col("event_id") % 3 == 0).alias("buy"), "event_id", F.col("sec").alias("t"), F.col("value").alias("amount"))
    # Slices of 300 s: between rows of two with an empty one between them is a pause. A row for each slice is ordered, not for each event.
    ev = ev.withColumn("slice", F.floor(F.col("t") / 300))
    slices = ev.where("t is not null").groupBy("symbol", "slice").agg(F.count("*").alias("n"), F.min(F.when(F.col("buy"), F.col("t"))).alias("first_buy"))
    by = Window.partitionBy("symbol").orderBy("slice")
    begins = F.coalesce(F.col("slice") - F.lag("slice").over(by) > 1, F.lit(True))
    before = F.sum("n").over(by) - F.col("n")
    runs = slices.withColumn("from", F.when(begins, before)).withColumn("run", F.floor(F.last("from", ignorenulls=True).over(by) / RUN_ROWS)).select("symbol", "slice", "run")
    ordered = ev.join(runs, ["symbol", "slice"]).repartition("symbol", "run").sortWithinPartitions("symbol", "run", "t", "event_id")
    matched = ordered.select("symbol", "run", "t", "event_id", "amount", "buy").mapInArrow(_matched, "symbol string, kind string, buy_id long, fill_id long, t long")
    since = slices.groupBy("symbol").agg((F.min("first_buy") - 300).alias("since"))
    timeless = ev.where("t is null and buy").select("symbol", F.lit("buy").alias("kind"), F.col("event_id").alias("buy_id"), F.lit(None).cast("long").alias("fill_id"))
    return matched.join(since, "symbol").where("kind <> 'fill' or t >= since").select("symbol", "kind", "buy_id", "fill_id").unionByName(timeless)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of symbol, run, t and event_id -> pairs, buys and fills left."""

    def told(symbol, done) -> pa.RecordBatch:
        buys, found, has, left, at = done
        n, m = len(buys), len(left)
        return pa.RecordBatch.from_arrays([
            pa.array([symbol]).take(pa.array(np.zeros(n + m, np.int32))), pa.array(["buy", "pair", "fill"]).take(pa.array(np.append(has.astype(np.int32), np.full(m, 2, np.int32)))),
            pa.array(np.append(buys, left), mask=np.arange(n + m) >= n), pa.array(np.append(found, left), mask=np.append(~has, np.zeros(m, bool))),
            pa.array(np.append(np.zeros(n, np.int64), at)),
        ], names=["symbol", "kind", "buy_id", "fill_id", "t"])

    key = live = None
    for batch in batches:
        runs, symbols = batch.column(1).to_numpy(), batch.column(0).dictionary_encode()
        codes = symbols.indices.to_numpy()
        t, ids, amount, buy = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
        heads = np.flatnonzero(np.append(True, (np.diff(runs) != 0) | (np.diff(codes) != 0))) if len(t) else []
        for a, b in zip(heads, np.append(heads[1:], len(t)), strict=True):
            own = (symbols.dictionary[int(codes[a])].as_py(), int(runs[a]))
            if own != key:
                if live is not None:
                    yield told(key[0], live.finish())
                key, live = own, P.NearestMatch(300, 0.35)
            done = live.add(t[a:b], ids[a:b], amount[a:b].astype(float), buy[a:b].astype(bool))
            if done is not None:
                yield told(key[0], done)
    if live is not None:
        yield told(key[0], live.finish())


ROUND_TRIPS = "WITH " + EV + ", e AS (SELECT 'S' || (user_id % 8) AS symbol, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, sec AS t, event_id, event_type = 'purchase' AS reduce FROM ev WHERE event_type = 'purchase' OR value <> 0), l AS (SELECT *, lag(reduce) OVER w AS was, lag(event_id) OVER w AS open_id, lag(t) OVER w AS t_open FROM e WINDOW w AS (PARTITION BY symbol, side ORDER BY t, event_id)) SELECT symbol, side, open_id, event_id AS close_id, t_open, t AS t_close FROM l WHERE reduce AND was = false"


@query("j9_round_trips", ROUND_TRIPS)
def _(v):
    """A reduce right after an open closes it, as a further open replaces the one before: the pairs are neighbours, no fold is needed."""
    ev = v.events.select(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("side"), F.col("sec").alias("t"), "event_id", (F.col("event_type") == "purchase").alias("reduce"), F.col("value").alias("entry"))
    ev = ev.where("reduce or entry <> 0").drop("entry")
    by = Window.partitionBy("symbol", "side").orderBy("t", "event_id")
    ev = ev.withColumn("was", F.lag("reduce").over(by)).withColumn("open_id", F.lag("event_id").over(by)).withColumn("t_open", F.lag("t").over(by))
    return ev.where("reduce and not was").select("symbol", "side", "open_id", F.col("event_id").alias("close_id"), "t_open", F.col("t").alias("t_close"))


@query("j10_disappeared", "WITH " + EV + ", p AS (SELECT DISTINCT user_id FROM ev WHERE sec < 1706572800), c AS (SELECT DISTINCT user_id FROM ev WHERE sec >= 1706572800 AND event_type = 'click'), r AS (SELECT DISTINCT user_id FROM ev WHERE sec >= 1706572800 AND event_type = 'signup') SELECT user_id FROM p EXCEPT SELECT user_id FROM c EXCEPT SELECT user_id FROM r")
def _(v):
    ev, cut = v.events, F.col("sec") >= 1706572800
    gone = J.without(ev.where(~cut).select("user_id").distinct(), ev.where(cut & (F.col("event_type") == "click")), ["user_id"])
    return J.without(gone, ev.where(cut & (F.col("event_type") == "signup")), ["user_id"])


@query("j11_last_event", "WITH " + EV + " SELECT event_type, max(sec) AS t, arg_max(value, (sec, event_id)) AS value, max(sec) >= (SELECT max(sec) FROM ev) - 900 AS fresh FROM ev GROUP BY 1")
def _(v):
    g = v.events.groupBy("event_type").agg(F.max("sec").alias("t"), F.max_by("value", F.struct("sec", "event_id")).alias("value"))
    return g.withColumn("fresh", F.col("t") >= F.max("t").over(Window.partitionBy()) - 900)  # a row for each type


LEAD_LAG = B + """, r AS (SELECT symbol, t, rn, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
z AS (SELECT t, rn, sum(r) OVER (ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / (stddev_pop(r) OVER (ORDER BY t ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) * sqrt(8) + 1e-9) AS z FROM r WHERE symbol = 'click')
SELECT b.symbol, b.t, round(CASE WHEN b.symbol = 'click' OR b.rn < 8 OR z.rn < 73 THEN 0 ELSE -tanh(z / 2) END, 6) AS vote FROM bars b JOIN z USING (t)"""


@query("j12_lead_lag", LEAD_LAG)
def _(v):
    """Against the leader's move of eight bars in units of its volatility over 64, on every other series; the leader itself: 0."""
    vol = Window.partitionBy("symbol").orderBy("t")
    lead = v.bars.where("symbol = 'click'").withColumn("r", W.log_return())
    z = F.sum("r").over(vol.rowsBetween(-7, 0)) / (F.stddev_pop("r").over(vol.rowsBetween(-63, 0)) * math.sqrt(8) + 1e-9)
    lead = lead.select("t", F.col("rn").alias("k"), z.alias("z"))
    vote = F.when((F.col("symbol") == "click") | (F.col("rn") < 8) | (F.col("k") < 73), 0.0).otherwise(-F.tanh(F.col("z") / 2))
    return v.bars.join(lead, "t").select("symbol", "t", F.round(vote, 6).alias("vote"))


@query("j13_two_series", B + ", r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k, high, low FROM bars), h AS (SELECT symbol, max(high) FILTER (WHERE k <= 10) AS h1, max(high) FILTER (WHERE k BETWEEN 11 AND 20) AS h0, min(low) FILTER (WHERE k <= 10) AS l1, min(low) FILTER (WHERE k BETWEEN 11 AND 20) AS l0 FROM r GROUP BY 1) SELECT a.symbol AS a, b.symbol AS b, CASE WHEN (a.h1 > a.h0) <> (b.h1 > b.h0) THEN -1 WHEN (a.l1 < a.l0) <> (b.l1 < b.l0) THEN 1 ELSE 0 END AS divergence FROM h a JOIN h b ON a.symbol < b.symbol")
def _(v):
    r = v.bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))).where("k <= 20")
    new = F.col("k") <= 10
    h = r.groupBy("symbol").agg(F.max(F.when(new, F.col("high"))).alias("h1"), F.max(F.when(~new, F.col("high"))).alias("h0"), F.min(F.when(new, F.col("low"))).alias("l1"), F.min(F.when(~new, F.col("low"))).alias("l0"))
    a, b = h.alias("a"), h.alias("b")
    tops = (F.col("a.h1") > F.col("a.h0")) != (F.col("b.h1") > F.col("b.h0"))
    lows = (F.col("a.l1") < F.col("a.l0")) != (F.col("b.l1") < F.col("b.l0"))
    return a.join(b, F.col("a.symbol") < F.col("b.symbol")).select(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b"), F.when(tops, -1).when(lows, 1).otherwise(0).alias("divergence"))


@query("j14_balanced_ranges", "WITH " + WALK + ", g AS (SELECT c.symbol, c.rn, c.t, 1 AS way, a.high AS lo, c.low AS hi FROM walk a JOIN walk c ON a.symbol = c.symbol AND c.rn = a.rn + 2 WHERE a.high < c.low UNION ALL SELECT c.symbol, c.rn, c.t, -1, c.high, a.low FROM walk a JOIN walk c ON a.symbol = c.symbol AND c.rn = a.rn + 2 WHERE a.low > c.high) SELECT u.symbol, u.t AS up_t, d.t AS down_t, round(greatest(u.lo, d.lo), 6) AS lo, round(least(u.hi, d.hi), 6) AS hi FROM g u JOIN g d ON u.symbol = d.symbol AND u.way = 1 AND d.way = -1 AND abs(u.rn - d.rn) <= 6 WHERE greatest(u.lo, d.lo) < least(u.hi, d.hi)")
def _(v):
    g = W.gaps(v.walk).join(v.walk.select("symbol", "t", "rn"), ["symbol", "t"])
    up = g.where("way = 1").select("symbol", F.col("t").alias("up_t"), F.col("rn").alias("up_rn"), F.col("gap_low").alias("ul"), F.col("gap_high").alias("uh"))
    down = g.where("way = -1").select(F.col("symbol").alias("r_symbol"), F.col("t").alias("down_t"), F.col("rn").alias("down_rn"), F.col("gap_low").alias("dl"), F.col("gap_high").alias("dh"))
    met = J.range_join(up, down, ["symbol"], F.col("up_rn") - 6, F.col("up_rn") + 6, "down_rn", 12)
    lo, hi = F.greatest("ul", "dl"), F.least("uh", "dh")
    return met.where(lo < hi).select("symbol", "up_t", "down_t", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("j15_price_enrichment", S + ", p AS (SELECT symbol, arg_max(close, t) AS price FROM bars WHERE symbol <> 'view' GROUP BY 1) SELECT signal_id, round(coalesce(price, entry), 6) AS mark, round((coalesce(price, entry) - entry) / entry * 100 * CASE WHEN side = 'LONG' THEN 1 ELSE -1 END, 6) AS pnl_pct FROM signals LEFT JOIN p USING (symbol)")
def _(v):
    last = v.bars.where("symbol <> 'view'").groupBy("symbol").agg(F.max_by("close", "t").alias("price"))
    mark = F.coalesce("price", "entry")
    return v.signals.join(last, "symbol", "left").select("signal_id", F.round(mark, 6).alias("mark"), F.round((mark - F.col("entry")) / F.col("entry") * 100 * F.when(F.col("side") == "LONG", 1).otherwise(-1), 6).alias("pnl_pct"))


@query("j16_prior_join", "WITH " + VOTES + " SELECT agent, round(avg(confidence), 6) AS confidence, round(coalesce(max(p.prior), 1.0)::DOUBLE, 6) AS prior FROM votes LEFT JOIN (VALUES ('click', 0.5), ('view', 1.5)) p(a, prior) ON p.a = agent GROUP BY agent")
def _(v):
    priors = v.spark.createDataFrame([("click", 0.5), ("view", 1.5)], "agent string, prior double")
    return v.votes.groupBy("agent").agg(F.round(F.avg("confidence"), 6).alias("confidence")).join(priors, "agent", "left").withColumn("prior", F.round(F.coalesce("prior", F.lit(1.0)), 6))


@query("t1_rank_signals", "WITH " + JOURNAL + " SELECT event_id, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(try_cast(nullif(ranking, '') AS DOUBLE), 0) DESC, event_id) AS place FROM journal QUALIFY place <= 20")
def _(v):
    from ..functions.scalars import safe_float

    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.coalesce(safe_float(F.col("ranking")), F.lit(0.0)).desc(), "event_id"))
    return v.journal.select("event_id", place.cast("bigint").alias("place")).where("place <= 20")


@query("t2_top_accepted", "WITH " + JOURNAL + " SELECT event_id, coalesce(try_cast(nullif(ranking, '') AS DOUBLE), 0) AS rank, implied_leverage FROM journal WHERE status = 'ACCEPTÉ' ORDER BY rank DESC, implied_leverage, event_id LIMIT 10")
def _(v):
    from ..functions.scalars import safe_float

    return v.journal.where("status = 'ACCEPTÉ'").select("event_id", F.coalesce(safe_float(F.col("ranking")), F.lit(0.0)).alias("rank"), "implied_leverage").orderBy(F.desc("rank"), "implied_leverage", "event_id").limit(10)


@query("t3_universe", "WITH u AS (SELECT p_name || '-' || p_partkey AS symbol, p_retailprice AS volume, p_partkey FROM part), a AS (SELECT symbol, 0 AS tier, volume FROM u WHERE p_partkey IN (1, 2, 3)), r AS (SELECT symbol, 1 AS tier, volume FROM u WHERE p_partkey NOT IN (1, 2, 3) AND p_partkey % 10 <> 0) SELECT symbol, row_number() OVER (ORDER BY tier, volume DESC, symbol) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM r) QUALIFY place <= 20")
def _(v):
    u = v.table("part").select(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("volume"), "p_partkey")
    anchor = F.col("p_partkey").isin(1, 2, 3)
    top = u.where(anchor | (F.col("p_partkey") % 10 != 0)).withColumn("tier", F.when(anchor, 0).otherwise(1)).orderBy("tier", F.desc("volume"), "symbol").limit(20)
    return top.select("symbol", F.row_number().over(Window.orderBy("tier", F.desc("volume"), "symbol")).cast("bigint").alias("place"))  # 20 rows


@query("t4_t5_basket", B + ", r AS (SELECT symbol, t, close, close / lag(close, 27) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret, lead(close, 4) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS fwd FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ret DESC, symbol) AS up, row_number() OVER (PARTITION BY t ORDER BY ret, symbol) AS down, count(*) OVER (PARTITION BY t) AS n FROM r WHERE ret IS NOT NULL) SELECT t, CASE WHEN count(fwd) FILTER (WHERE up <= 2 OR down <= 2) = 4 THEN round(avg(CASE WHEN up <= 2 THEN fwd ELSE -fwd END) FILTER (WHERE up <= 2 OR down <= 2), 6) END AS pnl FROM k WHERE n >= 4 GROUP BY t")
def _(v):
    r = v.bars.select("symbol", "t", (F.try_divide("close", W.lag("close", 27)) - 1).alias("ret"), (F.try_divide(W.lead("close", 4), "close") - 1).alias("fwd")).where("ret is not null")
    at = Window.partitionBy("t")
    k = r.withColumn("up", F.row_number().over(at.orderBy(F.desc("ret"), "symbol"))).withColumn("down", F.row_number().over(at.orderBy("ret", "symbol"))).withColumn("n", F.count("*").over(at)).where("n >= 4")
    g = k.groupBy("t").agg(F.count(F.when((F.col("up") <= 2) | (F.col("down") <= 2), F.col("fwd"))).alias("known"), F.avg(F.when(F.col("up") <= 2, F.col("fwd")).when(F.col("down") <= 2, -F.col("fwd"))).alias("pnl"))
    return g.select("t", F.when(F.col("known") == 4, F.round("pnl", 6)).alias("pnl"))


@query("t6_latest_per_key", touch_sql("AMBIGU") + " SELECT symbol, side, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY t DESC) AS k FROM o) WHERE k = 1")
def _(v):
    return J.latest_per(outcomes(v), ["symbol", "side"], [F.desc("t")]).select("symbol", "side", "signal_id")


@query("t7_last_by_place", "WITH " + JOURNAL + " SELECT symbol, status, max(event_id) AS event_id, min(event_id) AS first_seen FROM journal GROUP BY 1, 2")
def _(v):
    return v.journal.groupBy("symbol", "status").agg(F.max_by("event_id", "event_id").alias("event_id"), F.min("event_id").alias("first_seen"))


@query("t8_tail", "WITH " + JOURNAL + " SELECT event_id, symbol FROM journal ORDER BY event_id DESC LIMIT 5")
def _(v):
    return v.journal.select("event_id", "symbol").orderBy(F.desc("event_id")).limit(5)


@query("t9_event_feed", "WITH " + EV + " SELECT * FROM (SELECT sec AS t, 'order' AS kind, event_id AS id FROM ev WHERE event_type = 'purchase' UNION ALL SELECT sec, 'note', event_id FROM ev WHERE event_type = 'view' UNION ALL SELECT sec, 'signup', event_id FROM ev WHERE event_type = 'signup') ORDER BY t DESC, id DESC LIMIT 12")
def _(v):
    part = lambda kind, label: v.events.where(F.col("event_type") == kind).select(F.col("sec").alias("t"), F.lit(label).alias("kind"), F.col("event_id").alias("id"))
    return part("purchase", "order").unionByName(part("view", "note")).unionByName(part("signup", "signup")).orderBy(F.desc("t"), F.desc("id")).limit(12)


@query("t10_set_operations", "WITH " + EV + ", a AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(v):
    one = lambda kind: v.events.where(F.col("event_type") == kind).select("user_id").distinct()
    a, b = one("click"), one("signup")
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("only_a").alias("part"), F.count("*").alias("n")))


@query("t11_ring_buffer", "WITH " + EV + " SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sec DESC, event_id DESC) <= 50")
def _(v):
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("sec"), F.desc("event_id")))
    return v.events.select("event_type", "event_id", k.alias("k")).where("k <= 50").select("event_type", "event_id")


@query("t12_stride_sample", B + " SELECT symbol, t FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE rn > 20 AND (rn - 1 - 20) % greatest(3, (n - 20) // 40) = 0")
def _(v):
    n = F.count("*").over(Window.partitionBy("symbol"))
    return v.bars.withColumn("step", F.greatest(F.lit(3), F.floor((n - 20) / 40))).where("rn > 20 and (rn - 21) % step = 0").select("symbol", "t")


@query("t13_recall", "WITH " + EV + ", s AS (SELECT event_id, ['symbol=' || event_type, 'side=' || (user_id % 2), 'hour=' || (sec // 3600) % 24, 'size=' || (value > 50)] AS tokens FROM ev), j AS (SELECT q.event_id AS query_event_id, s.event_id, round(len(list_intersect(q.tokens, s.tokens))::DOUBLE / len(list_distinct(list_concat(q.tokens, s.tokens))), 6) AS similarity FROM s q JOIN s ON s.event_id <> q.event_id WHERE q.event_id % 100 = 0) SELECT * FROM j WHERE similarity >= 0.34 QUALIFY row_number() OVER (PARTITION BY query_event_id ORDER BY similarity DESC, event_id) <= 5")
def _(v):
    """The nearest remembered situations of every hundredth one."""
    word = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    tokens = F.array(word("symbol=", F.col("event_type")), word("side=", F.col("user_id") % 2), word("hour=", F.floor(F.col("sec") / 3600) % 24), word("size=", F.col("value") > 50))
    near = J.similar_sets(v.events.select("event_id", tokens.alias("tokens")), F.col("event_id") % 100 == 0, 0.34, 5)
    return near.withColumn("similarity", F.round("similarity", 6))


@query("t14_budget_allocation", "WITH RECURSIVE " + EV + ", o AS (SELECT user_id % 50 AS book, event_id, value AS x, (event_id % 40) / 100.0::DOUBLE AS d, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS rn FROM ev), a AS (SELECT book, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0 AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS risk, false AS accepted, '' AS reasons FROM (SELECT DISTINCT book FROM o) UNION ALL SELECT book, rn, event_id, n + ok::INT, total + CASE WHEN ok THEN x ELSE 0 END, risk + ok::INT, ok, why FROM (SELECT *, why = '' AS ok FROM (SELECT a.book, o.rn, o.event_id, a.n, a.total, a.risk, o.x, array_to_string(list_filter([CASE WHEN o.d < 0.2 THEN 'stop_distance' END, CASE WHEN a.n + 1 > 3 THEN 'positions' END, CASE WHEN a.total + o.x > 300 THEN 'notional' END, CASE WHEN a.risk + 1 > 5 THEN 'risk' END], lambda y: y IS NOT NULL), ',') AS why FROM a JOIN o ON o.book = a.book AND o.rn = a.rn + 1))) SELECT book, event_id, accepted, reasons FROM a WHERE rn > 0")
def _(v):
    """Orders of each user group in turn against caps; accepted ones use up the budget, refused ones don't."""
    df = v.events.select((F.col("user_id") % 50).alias("book"), "event_id", F.col("value").alias("notional"), (F.col("event_id") % 40 / 100.0).alias("distance"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("event_id", ignore_index=True)
        why = P.allocate(g["notional"].to_numpy(float), g["distance"].to_numpy(float), 1.0, 0, 3, 300.0, 5.0, 0.2)
        return pd.DataFrame({"book": g["book"], "event_id": g["event_id"], "accepted": [not w for w in why], "reasons": [",".join(w) for w in why]})

    return df.groupBy("book").applyInPandas(run, "book long, event_id long, accepted boolean, reasons string")
