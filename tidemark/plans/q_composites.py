"""Compositions: snapshots, votes fed by input tables, alerts, evaluations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds as P
from ..operators import microstructure as M
from ..operators import profiles as V
from ..operators import quant as Q
from ..operators import windows as W
from ..sources import parsers
from .q_aggregates import LEVELS, TIERS
from .q_joins import outcomes, touch_sql
from .q_quant import PAIRS, RANKS, pairs
from .q_windows import CLV, B, BY, R, RSI, TR, ema_sql, frame
from .registry import query
from .views import BOOK, EV, SIGNALS, TAPE, VENUES, VOTES, WALK

E = "WITH " + EV
VE = "WITH " + VENUES
VO = "WITH " + VOTES
O = touch_sql("AMBIGU")


@query("x2_market_snapshot", "WITH " + TAPE + ", " + VENUES + ", t AS (SELECT symbol, sum(CASE side WHEN 'buy' THEN size ELSE -size END) AS cvd, arg_max(price, (t, event_id)) AS last FROM tape GROUP BY 1), v AS (SELECT sum(oi_usd) AS oi, sum(funding * oi_usd) / sum(oi_usd) AS f FROM venues) SELECT symbol, round(cvd, 4) AS cvd, last, round(coalesce(oi, 0), 2) AS open_interest, round(coalesce(f, 0), 9) AS funding FROM t LEFT JOIN v ON true")
def _(v):
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    t = v.tape.groupBy("symbol").agg(F.round(F.sum(signed), 4).alias("cvd"), F.max_by("price", F.struct("t", "event_id")).alias("last"))
    d = v.venues.agg(F.round(F.coalesce(F.sum("oi_usd"), F.lit(0.0)), 2).alias("open_interest"), F.round(F.coalesce(F.sum(F.col("funding") * F.col("oi_usd")) / F.sum("oi_usd"), F.lit(0.0)), 9).alias("funding"))
    return t.crossJoin(F.broadcast(d))  # one row


@query("x3_technicals", R + f", f AS {ema_sql(20, 'close').format(name='f')}, s AS {ema_sql(50, 'close').format(name='s')}, " + RSI + ", " + TR + ", l AS (SELECT symbol, max(rn) AS rn, round(sum((high + low + close) / 3 * volume) / sum(volume), 6) AS vwap FROM bars GROUP BY 1) SELECT l.symbol, round(b.close, 6) AS close, vwap, round(f.ema, 6) AS ema20, round(s.ema, 6) AS ema50, round(rsi, 6) AS rsi14, round(atr, 6) AS atr14 FROM l JOIN bars b USING (symbol, rn) LEFT JOIN f USING (symbol, rn) LEFT JOIN s USING (symbol, rn) LEFT JOIN rsi USING (symbol, rn) LEFT JOIN aw USING (symbol, rn)")
def _(v):
    """The last value of each indicator of a series; null where the series is too short."""
    df = P.indicators(v.bars, 20, 50)
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    g = df.groupBy("symbol").agg(F.max_by(F.struct("close", "ema_fast", "ema_slow", "rsi", "atr"), "t").alias("l"), F.round(F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")) / F.sum("volume"), 6).alias("vwap"))
    return g.select("symbol", F.round("l.close", 6).alias("close"), "vwap", *[F.round(known(F.col(f"l.{a}")), 6).alias(b) for a, b in (("ema_fast", "ema20"), ("ema_slow", "ema50"), ("rsi", "rsi14"), ("atr", "atr14"))])


@query("x6_signal_ids", O + " SELECT concat_ws('|', t::VARCHAR, symbol, side) AS id, outcome, CASE WHEN outcome IN ('TP TOUCHÉ', 'SL TOUCHÉ', 'AMBIGU') THEN 'final' ELSE 'open' END AS route FROM o")
def _(v):
    o = F.col("outcome")
    return outcomes(v).select(F.concat_ws("|", F.col("t").cast("string"), "symbol", "side").alias("id"), "outcome", F.when(o.isin("TP TOUCHÉ", "SL TOUCHÉ", "AMBIGU"), "final").otherwise("open").alias("route"))


@query("x9_drawdown_state", O + ", r AS (SELECT symbol, t, CASE outcome WHEN 'TP TOUCHÉ' THEN 2.0 WHEN 'SL TOUCHÉ' THEN -1.0 ELSE 0.0 END AS r FROM o), e AS (SELECT symbol, t, 100 * exp(sum(ln(1 + r * 0.05)) OVER (PARTITION BY symbol ORDER BY t)) AS eq FROM r), d AS (SELECT *, greatest(100, max(eq) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak FROM e) SELECT symbol, round(max((peak - eq) / peak) * 100, 4) AS dd_pct, max((peak - eq) / peak) * 100 >= 20 AS halt, round(arg_max(eq, t), 4) AS equity, count(*) AS n FROM d GROUP BY symbol")
def _(v):
    r = F.when(F.col("outcome") == "TP TOUCHÉ", 2.0).when(F.col("outcome") == "SL TOUCHÉ", -1.0).otherwise(0.0)
    w = W.by().rowsBetween(Window.unboundedPreceding, 0)
    e = outcomes(v).select("symbol", "t", (100 * F.exp(F.sum(F.log(1 + r * 0.05)).over(w))).alias("eq"))
    e = e.withColumn("peak", F.greatest(F.lit(100.0), F.max("eq").over(w))).withColumn("dd", (F.col("peak") - F.col("eq")) / F.col("peak") * 100)
    return e.groupBy("symbol").agg(F.round(F.max("dd"), 4).alias("dd_pct"), (F.max("dd") >= 20).alias("halt"), F.round(F.max_by("eq", "t"), 4).alias("equity"), F.count("*").alias("n"))


@query("x10_numeraire", B + ", c AS (SELECT symbol, t, (close / lag(close, 28) OVER (PARTITION BY symbol ORDER BY t) - 1) * 100 AS usd FROM bars) SELECT symbol, t, CASE WHEN usd <= -3 THEN 'REFUGE' ELSE 'USDT' END AS hold FROM c")
def _(v):
    usd = (F.try_divide("close", W.lag("close", 28)) - 1) * 100
    return v.bars.select("symbol", "t", F.when(usd <= -3, "REFUGE").otherwise("USDT").alias("hold"))


@query("x14_edge_alerts", "WITH " + PAIRS + ", " + RANKS + " SELECT agent, n, abs(ic * sqrt((n - 2) / (1 - ic * ic))) >= 1.0 AND n >= 100 AS alert FROM ic")
def _(v):
    return Q.rank_ic(pairs(v), ["agent"]).select("agent", "n", ((F.abs("ic_t") >= 1.0) & (F.col("n") >= 100)).alias("alert"))


@query("x17_projection", B + f", r AS (SELECT *, ln(close / lag(close) OVER {BY}) AS r FROM bars), g AS (SELECT symbol, arg_max(close, t) AS s, stddev_pop(r) AS v FROM r GROUP BY 1), p AS (SELECT *, s * v * sqrt(24) AS em, -0.5 * v * sqrt(24) AS d FROM g) SELECT symbol, round(s, 4) AS price, round(em, 4) AS exp_move, round(s - em, 4) AS low, round(s + em, 4) AS high, round({S.normal_cdf_sql('d')}, 6) AS p_up FROM p")
def _(v):
    g = v.bars.withColumn("r", W.log_return()).groupBy("symbol").agg(F.max_by("close", "t").alias("s"), F.stddev_pop("r").alias("v"))
    g = g.withColumn("em", F.col("s") * F.col("v") * math.sqrt(24)).withColumn("d", -0.5 * F.col("v") * math.sqrt(24))
    return g.select("symbol", F.round("s", 4).alias("price"), F.round("em", 4).alias("exp_move"), F.round(F.col("s") - F.col("em"), 4).alias("low"), F.round(F.col("s") + F.col("em"), 4).alias("high"), F.round(S.normal_cdf(F.col("d")), 6).alias("p_up"))


@query("x17_cluster_touch", VE + LEVELS + f", z AS (SELECT exchange, side, lev, mark AS s, mark * (1 + distance_pct / 100) AS k FROM lv JOIN venues USING (exchange)), d AS (SELECT *, (ln(s / k) - 0.5 * 0.02 * 0.02 * 24) / (0.02 * sqrt(24)) AS d2 FROM z) SELECT exchange, side, lev AS leverage, round(least(1, 2 * CASE WHEN k >= s THEN {S.normal_cdf_sql('d2')} ELSE 1 - {S.normal_cdf_sql('d2')} END), 5) AS prob FROM d")
def _(v):
    lv = V.liquidation_levels(v.venues, TIERS).join(v.venues.select("exchange", F.col("mark").alias("s")), "exchange")
    lv = lv.withColumn("k", F.col("s") * (1 + F.col("distance_pct") / 100)).withColumn("sigma", F.lit(0.02)).withColumn("term", F.lit(24.0))
    return S.options(lv, "s", "k", "sigma", "term").select("exchange", "side", "leverage", F.round("touch", 5).alias("prob"))


@query("x19_input_votes", E + ", x AS (SELECT event_id, (user_id % 21 - 10) / 10.0::DOUBLE AS imb, event_id % 3 - 1 AS cvd, value, (user_id % 40 - 20) / 20000.0::DOUBLE AS f, (event_id % 41 - 20) / 15.0::DOUBLE AS net FROM ev) SELECT event_id, round(greatest(-1, least(1, 2 * imb + 0.3 * cvd)), 6) AS orderflow, round(least(1, abs(imb) * 1.5), 6) AS orderflow_confidence, round(greatest(-1, least(1, (50 - value) / 50)), 6) AS sentiment, round(greatest(-1, least(1, -2000 * f)), 6) AS derivs, round(greatest(-1, least(1, net)), 6) AS liquidations, CASE WHEN user_id2 = 0 THEN 0.6 WHEN user_id2 = 1 THEN -0.6 ELSE 0.0 END::DOUBLE AS macro FROM (SELECT x.*, event_id % 3 AS user_id2 FROM x)")
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    imb, cvd, f, net = (u % 21 - 10) / 10.0, e % 3 - 1, (u % 40 - 20) / 20000.0, (e % 41 - 20) / 15.0
    r = lambda c, n: F.round(c, 6).alias(n)
    return v.events.select("event_id", r(S.clamp(2 * imb + 0.3 * cvd), "orderflow"), r(F.least(F.lit(1.0), F.abs(imb) * 1.5), "orderflow_confidence"), r(S.clamp((50 - F.col("value")) / 50), "sentiment"), r(S.clamp(-2000 * f), "derivs"), r(S.clamp(net), "liquidations"), F.when(e % 3 == 0, 0.6).when(e % 3 == 1, -0.6).otherwise(0.0).alias("macro"))


@query("x20_technicals_vote", R + f", f AS {ema_sql(20, 'close').format(name='f')}, s AS {ema_sql(50, 'close').format(name='s')}, " + RSI + f", w AS (SELECT a.symbol, a.rn, sum(CASE WHEN b.close > b.open THEN 1 WHEN b.close < b.open THEN -1 ELSE 0 END * CASE WHEN b.volume > b.was AND b.rn > greatest(1, a.rn - 19) THEN 3 ELSE 1 END) AS bias FROM bars a JOIN (SELECT *, lag(volume) OVER {BY} AS was FROM bars) b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL), x AS (SELECT b.symbol, b.t, round(s.ema, 9) AS e50, greatest(-1, least(1, CASE WHEN round(f.ema, 9) > round(s.ema, 9) THEN 0.5 ELSE -0.5 END + CASE WHEN rsi < 35 THEN 0.3 WHEN rsi > 65 THEN -0.3 ELSE 0 END + 0.4 * greatest(-1, least(1, bias / 10)))) AS vote FROM bars b JOIN f USING (symbol, rn) JOIN s USING (symbol, rn) JOIN rsi USING (symbol, rn) JOIN w USING (symbol, rn)) SELECT symbol, t, round(vote, 6) AS vote, round(CASE WHEN vote > 0 THEN e50 END, 6) AS invalid_below, round(CASE WHEN vote < 0 THEN e50 END, 6) AS invalid_above FROM x")
def _(v):
    """Votes with the level that voids them: a long holds above the slow average only."""
    df = W.volume_bias(P.indicators(v.bars, 20, 50)).where("ema_slow is not null and not isnan(ema_slow)")
    f, s, r = F.round("ema_fast", 9), F.round("ema_slow", 9), F.col("rsi")
    vote = S.clamp(F.when(f > s, 0.5).otherwise(-0.5) + F.when(r < 35, 0.3).when(r > 65, -0.3).otherwise(0.0) + 0.4 * S.clamp(F.col("bias") / 10))
    df = df.withColumn("vote", vote)
    return df.select("symbol", "t", F.round("vote", 6).alias("vote"), F.round(F.when(F.col("vote") > 0, s), 6).alias("invalid_below"), F.round(F.when(F.col("vote") < 0, s), 6).alias("invalid_above"))


@query("x21_adjusted_conviction", VO + ", c AS (SELECT symbol, t, sum(vote * confidence) / sum(confidence) AS con FROM votes GROUP BY 1, 2), a AS (SELECT v.symbol, v.t, max(con) AS con, avg(CASE WHEN confidence > 0.05 AND vote <> 0 THEN (sign(vote) = sign(con))::INT END) AS agree, count(*) FILTER (WHERE confidence >= 0.4 AND abs(vote) >= 0.5 AND (vote > 0) <> (con > 0)) AS against FROM votes v JOIN c USING (symbol, t) GROUP BY 1, 2) SELECT symbol, t, round(abs(con) * CASE WHEN against >= 2 THEN 0.15 WHEN agree >= 0.85 AND abs(con) >= 0.4 THEN 0.8 ELSE 1.0 END, 6) AS conviction FROM a")
def _(v):
    from ..operators.ensemble import cognition

    c = cognition(v.votes.withColumn("weight", F.lit(1.0)))
    return c.select("symbol", "t", F.round(F.abs("consensus") * F.col("prudence"), 6).alias("conviction"))


@query("x23_macro_snapshot", B + f", x AS (SELECT symbol, t, close, lag(close, 5) OVER {BY} AS five, lag(close, 12) OVER {BY} AS year, lag(close) OVER {BY} AS was FROM bars) SELECT symbol, round(arg_max(close, t), 6) AS last, round(arg_max((close / five - 1) * 100, t), 6) AS change_pct, round(arg_max((close / year - 1) * 100, t), 6) AS yoy_pct, round(arg_max(close - was, t), 6) AS delta FROM x GROUP BY symbol")
def _(v):
    c = F.col("close")
    x = v.bars.select("symbol", "t", "close", ((F.try_divide(c, W.lag("close", 5)) - 1) * 100).alias("a"), ((F.try_divide(c, W.lag("close", 12)) - 1) * 100).alias("b"), (c - W.lag("close")).alias("d"))
    g = x.groupBy("symbol").agg(F.max_by(F.struct("close", "a", "b", "d"), "t").alias("l"))
    return g.select("symbol", F.round("l.close", 6).alias("last"), F.round("l.a", 6).alias("change_pct"), F.round("l.b", 6).alias("yoy_pct"), F.round("l.d", 6).alias("delta"))


@query("x25_universe_builder", "WITH u AS (SELECT p_partkey, 'P' || p_partkey || 'USDT' AS symbol, p_retailprice AS volume FROM part), q AS (SELECT symbol FROM u WHERE p_partkey % 2 = 0), a AS (SELECT symbol, 0 AS tier, volume FROM u WHERE p_partkey IN (1, 2)), r AS (SELECT symbol, 1 AS tier, volume FROM u WHERE symbol IN (SELECT symbol FROM q) AND p_partkey NOT IN (1, 2)) SELECT symbol FROM (SELECT * FROM a UNION ALL SELECT * FROM r) ORDER BY tier, volume DESC, symbol LIMIT 12")
def _(v):
    k = F.col("p_partkey")
    u = v.table("part").select(k, F.concat(F.lit("P"), k.cast("string"), F.lit("USDT")).alias("symbol"), F.col("p_retailprice").alias("volume"))
    good = u.where(k % 2 == 0).select("symbol")
    anchors = u.where(k.isin(1, 2)).select("symbol", F.lit(0).alias("tier"), "volume")
    rest = u.where(~k.isin(1, 2)).join(good, "symbol", "left_semi").select("symbol", F.lit(1).alias("tier"), "volume")
    return anchors.unionByName(rest).orderBy("tier", F.desc("volume"), "symbol").limit(12).select("symbol")


@query("x27_nudges", B + f", z AS (SELECT symbol, t, CASE WHEN rn >= 10 THEN (close - avg(close) OVER {frame(29)}) / nullif(stddev_pop(close) OVER {frame(29)}, 0) END AS z, (close / lag(close, 28) OVER {BY} - 1) * 100 AS m FROM bars) SELECT symbol, t, round(0.3 - 0.2 * tanh(z), 6) AS trend_up, round(-0.3 - 0.2 * tanh(z), 6) AS trend_down, round(m, 6) AS month_pct FROM z")
def _(v):
    df = v.bars.select("symbol", "t", W.zscore("close", 30).alias("z"), ((F.try_divide("close", W.lag("close", 28)) - 1) * 100).alias("m"))
    pull = 0.2 * F.tanh("z")
    return df.select("symbol", "t", F.round(0.3 - pull, 6).alias("trend_up"), F.round(-0.3 - pull, 6).alias("trend_down"), F.round("m", 6).alias("month_pct"))


@query("x28_carry_evaluation", VE + ", h AS (SELECT exchange, funding * 3 * 365 * 100 AS gross, funding * 3 * 365 * 100 - 0.2 * 365 / 30 AS net FROM venues) SELECT exchange, round(gross, 6) AS gross, round(net, 6) AS net, CASE WHEN net >= 5 THEN 'ATTRACTIF' WHEN net >= 0 THEN 'NEUTRE' ELSE 'NEGATIF' END AS label, round((1.5 * 1.0 + 2.0 * 0.9) * mark, 4) AS cover FROM h JOIN venues USING (exchange)")
def _(v):
    from ..functions.decisions import carry_label

    held = v.spark.createDataFrame([("BTC", 1.5, 1.0), ("BGBTC", 2.0, 0.9)], "coin string, quantity double, haircut double")
    q = held.agg(F.sum(F.col("quantity") * F.col("haircut")).alias("q"))
    gross = F.col("funding") * 3 * 365 * 100
    net = gross - 0.2 * 365 / 30
    return v.venues.crossJoin(F.broadcast(q)).select("exchange", F.round(gross, 6).alias("gross"), F.round(net, 6).alias("net"), carry_label(net).alias("label"), F.round(F.col("q") * F.col("mark"), 4).alias("cover"))  # one row


@query("x29_kelly_sizes", E + ", k AS (SELECT event_type, avg((value > 40)::INT) AS w, avg(value) FILTER (WHERE value > 40) / avg(value) FILTER (WHERE value <= 40) AS r FROM ev GROUP BY 1), f AS (SELECT event_type, greatest(0, least(0.25, 0.5 * (w - (1 - w) / r))) AS f FROM k) SELECT event_type, surface, round(least(f * 100, cap), 2) AS size FROM f, (VALUES ('spot', 10.0), ('margin', 15.0), ('futures', 50.0)) s(surface, cap)")
def _(v):
    hot = F.col("value") > 40
    k = v.events.groupBy("event_type").agg(F.avg(hot.cast("int")).alias("w"), (F.avg(F.when(hot, F.col("value"))) / F.avg(F.when(~hot, F.col("value")))).alias("r"))
    caps = F.array(*[F.struct(F.lit(n).alias("surface"), F.lit(c).alias("cap")) for n, c in (("spot", 10.0), ("margin", 15.0), ("futures", 50.0))])
    return k.select("event_type", S.kelly(F.col("w"), F.col("r")).alias("f"), F.explode(caps).alias("s")).select("event_type", "s.surface", F.round(F.least(F.col("f") * 100, F.col("s.cap")), 2).alias("size"))


@query("x30_next_event", E + " SELECT event_type, min(sec) FILTER (WHERE sec >= 1705276800) AS next_t, arg_min(event_id, (sec, event_id)) FILTER (WHERE sec >= 1705276800) AS event_id FROM ev GROUP BY 1")
def _(v):
    ahead = F.when(F.col("sec") >= 1_705_276_800, F.struct("sec", "event_id"))
    return v.events.groupBy("event_type").agg(F.min(ahead).alias("f")).select("event_type", F.col("f.sec").alias("next_t"), F.col("f.event_id").alias("event_id"))


@query("s15_chain_payloads", B + " SELECT symbol, t, close AS value FROM bars WHERE rn % 9 <> 0")
def _(v):
    """Points of a chart, some negative: those are dropped."""
    y = F.when(F.col("rn") % 9 == 0, -1.0).otherwise(F.col("close"))
    p = v.bars.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("t").alias("x"), y.alias("y"))).alias("values"))).alias("payload"))
    rows = p.select("symbol", F.explode(F.from_json("payload", "struct<values:array<struct<x:string,y:string>>>")["values"]).alias("v"))
    return rows.select("symbol", F.expr("try_cast(v.x as bigint)").alias("t"), F.expr("try_cast(v.y as double)").alias("value")).where("t is not null and value >= 0")


@query("s17_volatility_payloads", B + " SELECT symbol, round(arg_max(close, t), 6) AS last_close, count(*) AS n FROM bars GROUP BY 1")
def _(v):
    row = F.array((F.col("t") * 1000).cast("double"), "open", "high", "low", "close")
    p = v.bars.groupBy("symbol").agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("data")).alias("result"))).alias("payload"))
    rows = p.select("symbol", F.explode(F.from_json("payload", "struct<result:struct<data:array<array<double>>>>")["result"]["data"]).alias("r"))
    return rows.groupBy("symbol").agg(F.round(F.max_by(F.get("r", F.lit(4)), F.get("r", F.lit(0))), 6).alias("last_close"), F.count("*").alias("n"))


@query("s18_ratio_payloads", B + ", l AS (SELECT symbol, arg_max(close / 50, t) AS ratio FROM bars GROUP BY 1) SELECT symbol, round(ratio, 6) AS ratio, round(CASE WHEN ratio >= 1 THEN least(1, (ratio - 1) / 1.5) ELSE -least(1, (1 / ratio - 1) / 1.5) END, 6) AS crowd FROM l")
def _(v):
    item = F.struct(F.col("t").cast("string").alias("ts"), (F.col("close") / 50).cast("string").alias("longShortAccountRatio"))
    p = v.bars.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    x = p.select("symbol", F.explode(F.from_json("payload", "struct<data:array<struct<ts:string,longShortAccountRatio:string>>>")["data"]).alias("x"))
    g = x.select("symbol", F.expr("try_cast(x.ts as double)").alias("t"), F.expr("try_cast(x.longShortAccountRatio as double)").alias("r")).where("r is not null").groupBy("symbol").agg(F.max_by("r", "t").alias("ratio"))
    return g.select("symbol", F.round("ratio", 6).alias("ratio"), F.round(S.crowd(F.col("ratio")), 6).alias("crowd"))


@query("a29_tier_tally", "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'LIVE' WHEN n_nationkey % 4 = 1 THEN 'PROBATION' ELSE 'PAPER' END AS tier, count(*) AS n FROM nation GROUP BY 1")
def _(v):
    k = F.col("n_nationkey") % 4
    return v.table("nation").groupBy(F.when(k == 0, "LIVE").when(k == 1, "PROBATION").otherwise("PAPER").alias("tier")).agg(F.count("*").alias("n"))


EQUITY = f"""{B}, r AS (SELECT symbol, t, 0.05 * (close / lag(close) OVER {BY} - 1) AS r FROM bars QUALIFY r IS NOT NULL),
p AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS path FROM r),
f AS (SELECT *, path - max(path) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS fall FROM p),
e AS (SELECT symbol, count(*)::DOUBLE AS t, 1 - exp(min(fall)) AS mdd, exp(avg(ln(1 + r)) * 24) - 1 AS growth, (avg(r) / stddev_samp(r)) ** 2 AS s2 FROM f GROUP BY 1),
x AS (SELECT *, s2 / (1 - 2 * s2) AS b FROM e)
SELECT symbol, round(mdd, 6) AS mdd, round(CASE WHEN mdd > 1e-9 THEN growth / mdd ELSE 0 END, 6) AS calmar,
  round(CASE WHEN s2 < 0.5 THEN b / sqrt(2 * b * b + (1 + 2 / (t - 2)) * b + 1 / (t - 2)) * sqrt(2 * b * b + (1 + 15 / (t - 2) - 2 / t) * b + 4 / t - 3 / (t + 2) - 1 / (t * t)) / (b + 1 / t) END, 6) AS replication FROM x"""


@query("q5_equity_measures", EQUITY)
def _(v):
    """Worst fall, Calmar ratio and replication ratio of each series' returns."""
    r = v.bars.select("symbol", "t", (0.05 * (F.try_divide("close", W.lag("close")) - 1)).alias("r")).where("r is not null")
    e = Q.equity_measures(r, ["symbol"], "t", 24)
    return e.select("symbol", F.round("mdd", 6).alias("mdd"), F.round("calmar", 6).alias("calmar"), F.round("replication", 6).alias("replication"))


@query("r5_freshness_guard", "WITH " + TAPE + " SELECT symbol, event_id FROM tape WHERE t >= (SELECT max(t) FROM tape) - 7200")
def _(v):
    newest = v.tape.agg(F.max("t").alias("now"))
    return v.tape.crossJoin(F.broadcast(newest)).where("t >= now - 7200").select("symbol", "event_id")  # one row


@query("w18_kill_zones", B + ", n AS (SELECT symbol, t, hour(timezone('America/New_York', to_timestamp(t))) AS h FROM bars) SELECT symbol, t, h::INT AS ny_hour, CASE WHEN h >= 20 THEN 'asian' WHEN h >= 2 AND h < 5 THEN 'london' WHEN h >= 7 AND h < 10 THEN 'newyork' END AS zone, h IN (3, 10, 14) AS silver_bullet FROM n")
def _(v):
    from ..operators.structure import kill_zone

    return kill_zone(v.bars).select("symbol", "t", "ny_hour", "zone", "silver_bullet")


@query("s5_retention", E + " SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100")
def _(v):
    from ..sources.files import retain

    return retain(v.events.select("event_type", "event_id"), ["event_type"], [F.desc("event_id")], 100)


FLOW_SIGNAL = f"""WITH {WALK}, c AS (SELECT *, {CLV} AS clv FROM walk),
m AS (SELECT symbol, t, close, CASE WHEN sum(volume) OVER {frame(4)} > 0 THEN greatest(-1, least(1, sum(clv * volume) OVER {frame(4)} / sum(volume) OVER {frame(4)})) ELSE avg(clv) OVER {frame(4)} END AS ned FROM c QUALIFY row_number() OVER {BY} >= 5),
b AS (SELECT *, row_number() OVER {BY} AS rn, count(*) OVER (PARTITION BY symbol) AS n, last(ned) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now,
  max(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hi, min(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lo FROM m),
s AS (SELECT *, CASE WHEN close = hi THEN 'top' ELSE 'bottom' END AS side FROM b WHERE rn BETWEEN 3 AND n - 2 AND hi > lo AND (close = hi OR close = lo)),
d AS (SELECT *, sign(close - lag(close) OVER (PARTITION BY symbol, side ORDER BY t)) AS dp, sign(ned - lag(ned) OVER (PARTITION BY symbol, side ORDER BY t)) AS dn FROM s QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY t DESC) = 1),
z AS (SELECT u.symbol, u.n, p.dp AS pp, p.dn AS pn, p.rn AS pr, sign(p.now - p.ned) AS pf, q.dp AS qp, q.dn AS qn, q.rn AS qr, sign(q.now - q.ned) AS qf FROM (SELECT DISTINCT symbol, n FROM b) u
  LEFT JOIN d p ON p.symbol = u.symbol AND p.side = 'top' LEFT JOIN d q ON q.symbol = u.symbol AND q.side = 'bottom'),
g AS (SELECT symbol, CASE WHEN n < 7 THEN 0 WHEN qp > 0 AND qn <= 0 THEN 3 WHEN pp < 0 AND pn >= 0 THEN 4 WHEN pp > 0 AND pn > 0 THEN 1 WHEN pp < 0 AND pn < 0 THEN 2 WHEN pr >= n - 3 AND pf < 0 THEN 5 WHEN qr >= n - 3 AND qf > 0 THEN 6 ELSE 0 END AS signal FROM z)
SELECT symbol, signal, CASE signal WHEN 1 THEN 0.1 WHEN 2 THEN -0.1 WHEN 3 THEN 0.2 WHEN 6 THEN 0.2 WHEN 4 THEN -0.2 WHEN 5 THEN -0.2 ELSE 0.0 END::DOUBLE AS nudge FROM g"""


@query("f7_flow_signal", FLOW_SIGNAL)
def _(v):
    """Money flow against price: the signal of each series and the lean it gives."""
    from ..operators.strategies import flow_signals

    return flow_signals(W.money_flow(v.walk, 5).where("ned is not null").select("symbol", "t", "ned", "close"))


@query("x16_edge_summary", "WITH " + PAIRS + ", " + RANKS + " SELECT agent, n, round(ic, 6) AS ic FROM ic ORDER BY ic DESC, agent LIMIT 3")
def _(v):
    return Q.rank_ic(pairs(v), ["agent"]).select("agent", "n", F.round("ic", 6).alias("ic")).orderBy(F.desc("ic"), "agent").limit(3)


@query("x22_macro_votes", E + ", x AS (SELECT event_id, (user_id % 21 - 10) / 10.0::DOUBLE AS s, (event_id % 11) / 10.0::DOUBLE AS c FROM ev) SELECT event_id, CASE WHEN c > 0 THEN greatest(-1, least(1, -s)) ELSE 0.0 END AS vote, round(CASE WHEN c > 0 THEN least(1, c) * (0.4 + 0.6 * abs(s)) ELSE 0 END, 6) AS confidence FROM x")
def _(v):
    from ..functions.decisions import macro_vote

    m = macro_vote((F.col("user_id") % 21 - 10) / 10.0, (F.col("event_id") % 11) / 10.0)
    return v.events.select("event_id", (m["vote"] + 0.0).alias("vote"), F.round(m["confidence"], 6).alias("confidence"))


@query("x22_surprises", E + ", x AS (SELECT event_id, value AS a, CASE WHEN event_id % 6 <> 0 THEN 50.0::DOUBLE END AS f, user_id % 2 = 0 AS dove FROM ev) SELECT event_id, round(CASE WHEN f IS NOT NULL THEN greatest(-1, least(1, (a - f) / greatest(abs(f), 1e-9) / 0.1)) * CASE WHEN dove THEN -1 ELSE 1 END END, 6) AS pressure FROM x")
def _(v):
    from ..functions.decisions import surprise

    f = F.when(F.col("event_id") % 6 != 0, 50.0)
    return v.events.select("event_id", F.round(surprise(F.col("value"), f, F.col("user_id") % 2 == 0), 6).alias("pressure"))


@query("x31_ribbon_states", B + f", x AS (SELECT *, CASE WHEN rn >= 30 THEN avg(close) OVER {frame(29)} END AS fast, CASE WHEN rn >= 60 THEN avg(close) OVER {frame(59)} END AS slow FROM bars), c AS (SELECT *, coalesce(round(lag(fast) OVER {BY}, 9) < round(lag(slow) OVER {BY}, 9) AND round(fast, 9) > round(slow, 9), false)::INT AS crossed FROM x) SELECT symbol, t, CASE WHEN rn < 65 THEN 'neutre' WHEN max(crossed) OVER {frame(13)} = 1 THEN 'reprise' WHEN fast < slow THEN 'capitulation' ELSE 'neutre' END AS state FROM c")
def _(v):
    from ..functions.decisions import ribbon_state

    return W.ribbons(v.bars, "close").select("symbol", "t", ribbon_state(F.col("signal")).alias("state"))


@query("x32_venue_totals", "SELECT r_name AS chain, count(*) AS tokens, round(sum(c_acctbal), 2) AS total, max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS top FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(v):
    c, n, r = v.table("customer"), v.table("nation"), v.table("region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("chain")).agg(F.count("*").alias("tokens"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("top"))


@query("r6_buy_windows", E + " SELECT event_id, (sec % 86400) / 3600.0 >= 16 AND (sec % 86400) / 3600.0 < 20 OR user_id % 3 = 0 OR user_id % 3 = 1 AND (event_id % 50) > 30 AS ok, user_id % 3 = 0 OR CASE WHEN user_id % 3 = 1 THEN event_id % 50 ELSE 1 END >= 8 AS due FROM ev")
def _(v):
    from ..functions.decisions import buy_window, due

    u = F.col("user_id") % 3
    last = F.when(u == 1, F.col("sec") - (F.col("event_id") % 50) * 3600).when(u == 2, F.col("sec") - 3600)
    return v.events.select("event_id", buy_window(F.col("sec"), last).alias("ok"), due(F.col("sec"), last, 8).alias("due"))


@query("f4_implied_regime", B + f", x AS (SELECT symbol, t, close, lag(close, 4) OVER {BY} AS was, stddev_pop(close) OVER {frame(13)} AS rv FROM bars) SELECT symbol, t, CASE WHEN close < 40 THEN 'calme' WHEN close < 70 THEN 'normal' ELSE 'stress' END AS regime, coalesce((close - was) / was * 100 > 10, false) AS expansion, round(close - rv, 4) AS premium, round(CASE WHEN (close - 2) / 198 >= 1 THEN 1 WHEN close > 2 THEN sqrt((close - 2) / 198) ELSE 0 END, 6) AS congestion FROM x")
def _(v):
    from ..functions.decisions import congestion, implied_regime

    was = W.lag("close", 4)
    r = implied_regime(F.col("close"), (F.col("close") - was) / was * 100)
    return v.bars.select("symbol", "t", r["regime"].alias("regime"), r["expansion"].alias("expansion"), F.round(F.col("close") - F.stddev_pop("close").over(W.last(14)), 4).alias("premium"), F.round(congestion(F.col("close")), 6).alias("congestion"))


@query("f12_positioning", E + ", x AS (SELECT event_id, value + 1 AS a, (user_id % 30)::BIGINT AS l, (event_id % 37 - 3)::BIGINT AS s, event_id % 5 * 10.0::DOUBLE AS d FROM ev) SELECT event_id, round(CASE WHEN d > 0 THEN a / d END, 6) AS sector_ratio, CASE WHEN s >= 0 THEN l - s END AS net, round(CASE WHEN s >= 0 THEN CASE WHEN l + s > 0 THEN (l - s) * 100.0 / (l + s) ELSE 0 END END, 6) AS net_pct, CASE WHEN s >= 0 THEN CASE WHEN l > s THEN 'LONG' WHEN l < s THEN 'SHORT' ELSE 'FLAT' END END AS bias FROM x")
def _(v):
    """Net positions of a trader class, and the ratio of two sectors' prices."""
    from ..functions import decisions as D

    p = D.net_positioning(F.col("user_id") % 30, F.col("event_id") % 37 - 3)
    ratio = D.sector_ratio(F.col("value") + 1, F.col("event_id") % 5 * 10.0)
    return v.events.select("event_id", F.round(ratio, 6).alias("sector_ratio"), p["net"].alias("net"), F.round(p["net_pct"], 6).alias("net_pct"), p["bias"].alias("bias"))


INPUTS = E + """, x AS (SELECT event_id, (user_id % 21 - 10) / 10.0::DOUBLE AS imb, event_id % 3 - 1 AS cvd, CASE WHEN event_id % 7 > 0 THEN value END AS fear, CASE WHEN event_id % 5 > 0 THEN (user_id % 40 - 20) / 20000.0::DOUBLE END AS f,
  CASE WHEN event_id % 11 > 0 THEN (event_id % 41 - 20) / 15.0::DOUBLE END AS net, event_id % 4 AS reg, (user_id % 9 - 4) / 4.0::DOUBLE AS stance, (event_id % 6) / 5.0::DOUBLE AS cover, (value - 50) / 40 AS wk, (event_id % 20 - 10) / 10.0::DOUBLE AS mo, CASE WHEN event_id % 4 <> 0 THEN (user_id % 30 - 15) / 15.0::DOUBLE END AS crowd FROM ev),
y AS (SELECT *, CASE reg WHEN 0 THEN 0.6 WHEN 1 THEN -0.6 ELSE 0.0 END AS base, CASE WHEN reg < 2 THEN 0.5 ELSE 0.1 END AS bc, CASE WHEN cover > 0 THEN greatest(-1, least(1, -stance)) ELSE 0 END AS mv, CASE WHEN cover > 0 THEN least(1, cover) * (0.4 + 0.6 * abs(greatest(-1, least(1, -stance)))) ELSE 0 END AS mc, 0.6 * tanh(wk / 0.5) + 0.4 * tanh(mo / 2) AS fl,
  greatest(-1, least(1, -greatest(-1, least(1, wk / 2.5)) * CASE WHEN abs(coalesce(f, 0)) >= 0.0005 THEN 1.5 ELSE 1 END)) AS cf, -greatest(-1, least(1, mo / 0.5)) * 0.4 AS cb FROM x),
z AS (SELECT *, greatest(-1, least(1, (0.5 * cf + coalesce(0.35 * -crowd * 0.8, 0) + 0.15 * cb) / CASE WHEN crowd IS NULL THEN 0.65 ELSE 1.0 END)) AS ca FROM y),
v(event_id, agent, vote, confidence) AS (
  SELECT event_id, 'orderflow', greatest(-1, least(1, 2 * imb + 0.3 * cvd)), least(1, abs(imb) * 1.5) FROM z
  UNION ALL SELECT event_id, 'macro', CASE WHEN mc > 0 THEN greatest(-1, least(1, (base * bc + mv * mc) / (bc + mc))) ELSE base END, CASE WHEN mc > 0 THEN least(1, (bc + mc) / 1.5) ELSE bc END FROM z
  UNION ALL SELECT event_id, 'sentiment', CASE WHEN fear IS NULL THEN 0 ELSE greatest(-1, least(1, (50 - fear) / 50)) END, CASE WHEN fear IS NULL THEN 0 ELSE least(1, abs(50 - fear) / 50) END FROM z
  UNION ALL SELECT event_id, 'derivs', CASE WHEN f IS NULL THEN 0 ELSE greatest(-1, least(1, -2000 * f)) END, CASE WHEN f IS NULL THEN 0 ELSE least(1, 2000 * abs(f)) END FROM z
  UNION ALL SELECT event_id, 'liquidations', CASE WHEN net IS NULL THEN 0 ELSE greatest(-1, least(1, net)) END, CASE WHEN net IS NULL THEN 0 ELSE least(1, abs(net)) END FROM z
  UNION ALL SELECT event_id, 'flows', fl, least(0.5, abs(fl)) FROM z
  UNION ALL SELECT event_id, 'carry', ca, least(0.6, 1.2 * abs(ca)) FROM z)
SELECT event_id, agent, round(vote, 6)::DOUBLE AS vote, round(confidence, 6)::DOUBLE AS confidence FROM v"""


def agent_inputs(v):
    """What the agents that live on other tables than bars read, for each event."""
    e, u = F.col("event_id"), F.col("user_id")
    return v.events.select(
        "event_id", F.col("event_type").alias("symbol"), ((u % 21 - 10) / 10.0).alias("imbalance"), (e % 3 - 1).alias("cvd"), F.when(e % 7 > 0, F.col("value")).alias("fear"), F.when(e % 5 > 0, (u % 40 - 20) / 20000.0).alias("funding"),
        F.when(e % 11 > 0, (e % 41 - 20) / 15.0).alias("net"), F.when(e % 4 == 0, "RISK_ON").when(e % 4 == 1, "RISK_OFF").alias("regime"), ((u % 9 - 4) / 4.0).alias("stance"), ((e % 6) / 5.0).alias("coverage"),
        ((F.col("value") - 50) / 40).alias("week"), ((e % 20 - 10) / 10.0).alias("month"),
        F.when(e % 4 != 0, (u % 30 - 15) / 15.0).alias("crowd"),
    )


@query("q14_input_agents", INPUTS)
def _(v):
    """The seven agents that read order flow, macro, sentiment, derivatives, liquidations, supply and positioning."""
    from ..functions import decisions as D

    x = D.input_votes(agent_inputs(v), ["event_id"])
    return x.select("event_id", "agent", F.round("vote", 6).alias("vote"), F.round("confidence", 6).alias("confidence"))
