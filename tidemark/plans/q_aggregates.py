"""Reports and aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import reasons, safe_float
from ..operators import folds as P
from ..operators import profiles as V
from ..operators import windows as W
from ..operators.joins import running_sum
from .q_joins import outcomes, touch_sql
from .q_windows import B
from .registry import query
from .views import BARS, BOOK, EV, FILLS, JOURNAL, SIGNALS, TAPE, VENUES, VOTES

J = "WITH " + JOURNAL
FL = "WITH " + FILLS
VE = "WITH " + VENUES
VO = "WITH " + VOTES
T = "WITH " + TAPE
O = touch_sql("AMBIGU")


def num(name):
    return F.coalesce(safe_float(F.col(name)), F.lit(0.0))


NUM = "coalesce(try_cast(nullif({}, '') AS DOUBLE), 0.0)"


@query("a1_journal_summary", J + f" SELECT symbol, count(*) AS n, count(*) FILTER (WHERE status = 'ACCEPTÉ') AS accepted, count(*) FILTER (WHERE status = 'REFUSÉ') AS refused, round(avg({NUM.format('rsi')}), 6) AS avg_rsi, round(avg({NUM.format('ranking')}), 6) AS avg_ranking FROM journal GROUP BY symbol")
def _(v):
    return v.journal.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ACCEPTÉ").alias("accepted"), F.count_if(F.col("status") == "REFUSÉ").alias("refused"), F.round(F.avg(num("rsi")), 6).alias("avg_rsi"), F.round(F.avg(num("ranking")), 6).alias("avg_ranking"))


@query("a2_outcomes_by_symbol", O + " SELECT symbol, outcome, count(*) AS n FROM o GROUP BY 1, 2")
def _(v):
    return outcomes(v).groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


FINAL = ("TP TOUCHÉ", "SL TOUCHÉ", "AMBIGU")


@query("a3_win_stats", O + " SELECT symbol, side, count(*) AS total, count(*) FILTER (WHERE outcome = 'TP TOUCHÉ') AS tp, count(*) FILTER (WHERE outcome = 'SL TOUCHÉ') AS sl, count(*) FILTER (WHERE outcome = 'AMBIGU') AS ambigu, round(100.0 * count(*) FILTER (WHERE outcome = 'TP TOUCHÉ') / nullif(count(*) FILTER (WHERE outcome <> 'AMBIGU'), 0), 6) AS win_rate, round(count(*) FILTER (WHERE outcome = 'TP TOUCHÉ')::DOUBLE / nullif(count(*) FILTER (WHERE outcome = 'SL TOUCHÉ'), 0), 6) AS tp_sl FROM o WHERE outcome IN ('TP TOUCHÉ', 'SL TOUCHÉ', 'AMBIGU') GROUP BY GROUPING SETS ((), (symbol), (side))")
def _(v):
    df = outcomes(v).where(F.col("outcome").isin(*FINAL))
    tp, sl = F.count_if(F.col("outcome") == FINAL[0]), F.count_if(F.col("outcome") == FINAL[1])
    return df.groupingSets([[], ["symbol"], ["side"]], "symbol", "side").agg(
        F.count("*").alias("total"), tp.alias("tp"), sl.alias("sl"), F.count_if(F.col("outcome") == FINAL[2]).alias("ambigu"),
        F.round(100.0 * tp / F.nullif(tp + sl, F.lit(0)), 6).alias("win_rate"), F.round(tp / F.nullif(sl, F.lit(0)), 6).alias("tp_sl"))


@query("a4_issue_stats", O + ", c AS (SELECT CASE WHEN outcome LIKE '%TP%' THEN 'TP' WHEN outcome LIKE '%SL%' THEN 'SL' WHEN outcome LIKE '%AMBIG%' THEN 'AMBIGU' ELSE outcome END AS issue FROM o) SELECT count(*) AS n, count(*) FILTER (WHERE issue = 'TP') AS tp, count(*) FILTER (WHERE issue = 'SL') AS sl, round(100.0 * count(*) FILTER (WHERE issue = 'TP') / count(*) FILTER (WHERE issue IN ('TP', 'SL')), 4) AS wr_pct FROM c")
def _(v):
    o = F.col("outcome")
    issue = F.when(o.contains("TP"), "TP").when(o.contains("SL"), "SL").when(o.contains("AMBIG"), "AMBIGU").otherwise(o)
    df = outcomes(v).select(issue.alias("issue"))
    tp, sl = F.count_if(F.col("issue") == "TP"), F.count_if(F.col("issue") == "SL")
    share = F.coalesce(F.round(100.0 * tp / F.nullif(tp + sl, F.lit(0)), 4), F.lit(float("nan")))  # none decided: NaN, as in SQL
    return df.agg(F.count("*").alias("n"), tp.alias("tp"), sl.alias("sl"), share.alias("wr_pct"))


SINCE = 760_000_000


@query("a5_fills_summary", FL + f" SELECT count(*) AS n_fills, round(sum(amount), 2) AS volume, round(sum(profit), 2) AS pnl, round(sum(CASE WHEN fee_coin = 'USDT' THEN abs(fee) ELSE 0 END), 2) AS fees, round(sum(profit - CASE WHEN fee_coin = 'USDT' THEN abs(fee) ELSE 0 END), 2) AS net FROM fills WHERE c_time / 1000 >= {SINCE}")
def _(v):
    fee = F.when(F.col("fee_coin") == "USDT", F.abs("fee")).otherwise(0.0)
    df = v.fills.where(F.col("c_time") / 1000 >= SINCE)
    return df.agg(F.count("*").alias("n_fills"), F.round(F.sum("amount"), 2).alias("volume"), F.round(F.sum("profit"), 2).alias("pnl"), F.round(F.sum(fee), 2).alias("fees"), F.round(F.sum(F.col("profit") - fee), 2).alias("net"))


@query("a6_payoff_profile", FL + ", p AS (SELECT side, count(*) AS n, count(*) FILTER (WHERE profit > 0) * 1.0::DOUBLE / count(*) AS w, coalesce(avg(profit) FILTER (WHERE profit > 0), 0) AS g, coalesce(avg(profit) FILTER (WHERE profit < 0), 0) AS l FROM fills WHERE profit <> 0 GROUP BY side), e AS (SELECT *, g / nullif(abs(l), 0) AS payoff, w * g + (1 - w) * l AS expectancy FROM p) SELECT side, n, round(w, 6) AS win_rate, round(g, 4) AS avg_win, round(l, 4) AS avg_loss, round(payoff, 4) AS payoff, round(expectancy, 4) AS expectancy, CASE WHEN expectancy <= 0 THEN 'perdant' WHEN w >= 0.7 AND payoff < 0.5 THEN 'fragile' WHEN w <= 0.45 AND coalesce(payoff, 9) >= 1.8 THEN 'asymétrique+' ELSE 'robuste' END AS shape FROM e")
def _(v):
    p = F.col("profit")
    df = v.fills.where(p != 0).groupBy("side").agg(F.count("*").alias("n"), (F.count_if(p > 0) / F.count("*")).alias("w"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("g"), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("l"))
    df = df.withColumn("payoff", F.when(F.col("l") != 0, F.col("g") / F.abs("l"))).withColumn("expectancy", F.col("w") * F.col("g") + (1 - F.col("w")) * F.col("l"))
    shape = F.when(F.col("expectancy") <= 0, "perdant").when((F.col("w") >= 0.7) & (F.col("payoff") < 0.5), "fragile").when((F.col("w") <= 0.45) & (F.coalesce("payoff", F.lit(9.0)) >= 1.8), "asymétrique+").otherwise("robuste")
    return df.select("side", "n", F.round("w", 6).alias("win_rate"), F.round("g", 4).alias("avg_win"), F.round("l", 4).alias("avg_loss"), F.round("payoff", 4).alias("payoff"), F.round("expectancy", 4).alias("expectancy"), shape.alias("shape"))


@query("a7_funding_sum", FL + " SELECT fee_coin, count(*) AS n, round(sum(profit), 2) AS total, round(sum(greatest(profit, 0)), 2) AS received, round(sum(greatest(-profit, 0)), 2) AS paid FROM fills GROUP BY 1")
def _(v):
    p = F.col("profit")
    return v.fills.groupBy("fee_coin").agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("total"), F.round(F.sum(F.greatest(p, F.lit(0.0))), 2).alias("received"), F.round(F.sum(F.greatest(-p, F.lit(0.0))), 2).alias("paid"))


@query("a7_event_counts", "WITH " + EV + " SELECT event_type AS action, count(*) AS n FROM ev GROUP BY 1")
def _(v):
    return v.events.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("a8_consensus_stats", VO + ", c AS (SELECT symbol, t, abs(sum(vote * confidence) / sum(confidence)) AS c FROM votes GROUP BY ALL), k AS (SELECT round(c, 9) AS c, row_number() OVER (ORDER BY round(c, 9)) AS k, count(*) OVER () AS n FROM c) SELECT max(n) AS n, round(median(c), 6) AS p50, round(max(c) FILTER (WHERE k = greatest(1, floor(n * 0.9))), 6) AS p90, round(max(c), 6) AS top, round(100.0 * count(*) FILTER (WHERE c >= 0.35) / max(n), 6) AS pct FROM k")
def _(v):
    c = v.votes.groupBy("symbol", "t").agg(F.round(F.abs(F.sum(F.col("vote") * F.col("confidence")) / F.sum("confidence")), 9).alias("c"))
    # the 90th is an order statistic: the value that int(0.9 n) rows reach, found by counting equal values
    at = c.groupBy("c").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("c")))
    n = c.agg(F.count("*").alias("n"), F.round(F.percentile("c", 0.5), 6).alias("p50"), F.round(F.max("c"), 6).alias("top"), F.round(100.0 * F.count_if(F.col("c") >= 0.35) / F.count("*"), 6).alias("pct"))
    p90 = at.crossJoin(F.broadcast(n.select("n"))).where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.9))).agg(F.round(F.min("c"), 6).alias("p90"))
    return n.crossJoin(F.broadcast(p90)).select("n", "p50", "p90", "top", "pct")  # one row each


@query("a8_action_stats", "WITH " + EV + " SELECT 'auto:' || event_type AS loop_action, count(*) AS n FROM ev WHERE sec >= 1705276800 GROUP BY 1")
def _(v):
    return v.events.where("sec >= 1705276800").groupBy(F.concat(F.lit("auto:"), "event_type").alias("loop_action")).agg(F.count("*").alias("n"))


@query("a9_weighted_funding", VE + " SELECT round(sum(oi_usd), 2) AS total_oi, round(sum(CASE WHEN exchange = 'ASIA' THEN 0 ELSE funding END * oi_usd) / sum(oi_usd), 9) AS weighted_funding, count(*) AS n FROM venues")
def _(v):
    df = v.venues.withColumn("funding", F.when(F.col("exchange") != "ASIA", F.col("funding")))  # a venue without funding still weighs
    return df.agg(F.round(F.sum("oi_usd"), 2).alias("total_oi"), F.round(F.sum(F.coalesce("funding", F.lit(0.0)) * F.col("oi_usd")) / F.sum("oi_usd"), 9).alias("weighted_funding"), F.count("*").alias("n"))


@query("a10_venue_prices", VE + " SELECT round(avg(mark), 4) AS mean, round(median(mark), 4) AS median, arg_max(exchange, mark) AS top_venue, arg_min(exchange, mark) AS low_venue, round((max(mark) - min(mark)) / min(mark) * 100, 6) AS spread_pct, round(list_sort(list(mark))[3], 4) AS upper_median FROM venues")
def _(v):
    m = F.col("mark")
    up = F.element_at(F.sort_array(F.collect_list("mark")), (F.floor(F.count("*") / 2) + 1).cast("int"))  # a row for each venue
    return v.venues.agg(F.round(F.avg(m), 4).alias("mean"), F.round(F.percentile(m, 0.5), 4).alias("median"), F.max_by("exchange", m).alias("top_venue"), F.min_by("exchange", m).alias("low_venue"), F.round((F.max(m) - F.min(m)) / F.min(m) * 100, 6).alias("spread_pct"), F.round(up, 4).alias("upper_median"))


@query("a11_orders_from_fills", FL + " SELECT order_id, min(c_time) // 1000 AS t, round(sum(amount) / sum(size), 9) AS price_avg, sum(size) AS size, round(sum(amount), 2) AS amount, round(sum(CASE WHEN fee_coin = 'BTC' THEN abs(fee) ELSE 0 END), 6) AS fee FROM fills WHERE side = 'buy' GROUP BY 1")
def _(v):
    fee = F.when(F.col("fee_coin") == "BTC", F.abs("fee")).otherwise(0.0)
    return v.fills.where("side = 'buy' and size > 0 and amount > 0").groupBy("order_id").agg(F.expr("min(c_time) div 1000").alias("t"), F.round(F.sum("amount") / F.sum("size"), 9).alias("price_avg"), F.sum("size").alias("size"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.sum(fee), 6).alias("fee"))


@query("a12_balance", FL + ", s AS (SELECT sum(amount) AS usdt, sum(size) AS btc, sum(CASE WHEN fee_coin = 'BTC' THEN abs(fee) ELSE 0 END) AS fees, count(*) FILTER (WHERE size > 49) AS odd FROM fills WHERE side = 'buy') SELECT round(usdt, 2) AS usdt, round(btc, 2) AS btc, round(usdt / btc, 4) AS cost_basis, round((1500 / (usdt / btc) - 1) * 100, 4) AS pnl_pct, array_to_string(list_filter([CASE WHEN odd > 0 THEN 'orphans' END, CASE WHEN btc - fees > 1e12 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS anomalies FROM s")
def _(v):
    s = v.fills.where("side = 'buy'").agg(F.sum("amount").alias("usdt"), F.sum("size").alias("btc"), F.sum(F.when(F.col("fee_coin") == "BTC", F.abs("fee")).otherwise(0.0)).alias("fees"), F.count_if(F.col("size") > 49).alias("odd"))
    basis = F.col("usdt") / F.col("btc")
    return s.select(F.round("usdt", 2).alias("usdt"), F.round("btc", 2).alias("btc"), F.round(basis, 4).alias("cost_basis"), F.round((1500 / basis - 1) * 100, 4).alias("pnl_pct"), F.array_join(reasons(("orphans", F.col("odd") > 0), ("balance", F.col("btc") - F.col("fees") > 1e12)), ",").alias("anomalies"))


@query("a13_cost_basis", B + ", a AS (SELECT symbol, close, CASE WHEN rn % 5 = 0 THEN 3.0 ELSE 1.0 END AS amount FROM bars WHERE close > 0), c AS (SELECT symbol, sum(amount) / sum(amount / close) AS own, count(*) / sum(1 / close) AS flat FROM a GROUP BY 1) SELECT symbol, round(own, 6) AS cost_basis, round((flat - own) / flat * 100, 6) AS advantage_pct FROM c")
def _(v):
    df = v.bars.where("close > 0").withColumn("amount", F.when(F.col("rn") % 5 == 0, 3.0).otherwise(1.0)).groupBy("symbol").agg((F.sum("amount") / F.sum(F.col("amount") / F.col("close"))).alias("own"), (F.count("*") / F.sum(1 / F.col("close"))).alias("flat"))
    return df.select("symbol", F.round("own", 6).alias("cost_basis"), F.round((F.col("flat") - F.col("own")) / F.col("flat") * 100, 6).alias("advantage_pct"))


@query("a14_daily_spend", "WITH " + EV + " SELECT sec // 86400 AS day, round(sum(value), 4) AS spent, round(sum(value) FILTER (WHERE event_type = 'signup'), 4) AS lost FROM ev GROUP BY 1")
def _(v):
    return v.events.groupBy(F.floor(F.col("sec") / 86400).alias("day")).agg(F.round(F.sum("value"), 4).alias("spent"), F.round(F.sum(F.when(F.col("event_type") == "signup", F.col("value"))), 4).alias("lost"))


@query("a15_gross_book", O + " SELECT symbol, round(sum(entry), 4) AS gross, round(sum(CASE WHEN side = 'LONG' THEN entry ELSE -entry END), 4) AS net, count(*) AS n FROM o WHERE outcome LIKE 'EN COURS%' AND entry >= 1.0 GROUP BY 1")
def _(v):
    df = outcomes(v).where("outcome like 'EN COURS%' and entry >= 1.0")
    return df.groupBy("symbol").agg(F.round(F.sum("entry"), 4).alias("gross"), F.round(F.sum(F.when(F.col("side") == "LONG", F.col("entry")).otherwise(-F.col("entry"))), 4).alias("net"), F.count("*").alias("n"))


@query("a16_observation_mode", O + " SELECT symbol, CASE WHEN count(*) FILTER (WHERE outcome = 'EN COURS -') >= 3 THEN 'OBSERVATION' ELSE 'NORMAL' END AS mode, count(*) FILTER (WHERE outcome = 'EN COURS -') AS negative, count(*) FILTER (WHERE outcome = 'EN COURS +') AS positive FROM o GROUP BY 1")
def _(v):
    neg, pos = F.count_if(F.col("outcome") == "EN COURS -"), F.count_if(F.col("outcome") == "EN COURS +")
    return outcomes(v).groupBy("symbol").agg(F.when(neg >= 3, "OBSERVATION").otherwise("NORMAL").alias("mode"), neg.alias("negative"), pos.alias("positive"))


@query("a17_risk_level", B + ", l AS (SELECT symbol, arg_max(close, t) AS last FROM bars GROUP BY 1), p AS (SELECT b.symbol, (last - close) / close * 100 * CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END AS pnl, CASE WHEN rn % 2 = 0 THEN (last - 0.9 * close) / (0.1 * close) ELSE (1.1 * close - last) / (0.1 * close) END * 100 AS stop FROM bars b JOIN l USING (symbol) WHERE rn > 100), g AS (SELECT symbol, count(*) AS n, avg(pnl) AS a, min(pnl) AS w, count(*) FILTER (WHERE pnl < 0) AS neg, min(stop) AS s FROM p GROUP BY 1) SELECT symbol, round(a, 4) AS avg_pnl, round(w, 4) AS worst, neg AS negative, CASE WHEN w <= -1.25 OR a <= -0.5 OR s <= 10 THEN 'ÉLEVÉ' WHEN n >= 6 OR neg >= 3 OR a < 0 OR w <= -0.75 OR s <= 25 THEN 'MOYEN' ELSE 'FAIBLE' END AS level, CASE WHEN w <= -1.25 OR a <= -0.5 OR s <= 10 THEN 'RÉDUIRE RISQUE' WHEN n >= 6 OR neg >= 3 OR a < 0 OR w <= -0.75 OR s <= 25 THEN 'SURVEILLER' ELSE 'CONTINUER' END AS action FROM g")
def _(v):
    last = v.bars.groupBy("symbol").agg(F.max_by("close", "t").alias("last"))
    long, c, x = F.col("rn") % 2 == 0, F.col("close"), F.col("last")
    p = v.bars.where("rn > 100").join(last, "symbol").select("symbol", ((x - c) / c * 100 * F.when(long, 1).otherwise(-1)).alias("pnl"), (F.when(long, (x - 0.9 * c) / (0.1 * c)).otherwise((1.1 * c - x) / (0.1 * c)) * 100).alias("stop"))
    g = p.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("pnl").alias("a"), F.min("pnl").alias("w"), F.count_if(F.col("pnl") < 0).alias("neg"), F.min("stop").alias("s"))
    g = g.withColumn("level", F.expr("CASE WHEN w <= -1.25 OR a <= -0.5 OR s <= 10 THEN 'ÉLEVÉ' WHEN n >= 6 OR neg >= 3 OR a < 0 OR w <= -0.75 OR s <= 25 THEN 'MOYEN' ELSE 'FAIBLE' END"))
    return g.select("symbol", F.round("a", 4).alias("avg_pnl"), F.round("w", 4).alias("worst"), F.col("neg").alias("negative"), "level", F.when(F.col("level") == "ÉLEVÉ", "RÉDUIRE RISQUE").when(F.col("level") == "MOYEN", "SURVEILLER").otherwise("CONTINUER").alias("action"))


@query("a18_vwap", B + " SELECT symbol, round(sum((high + low + close) / 3 * volume) / sum(volume), 6) AS vwap, round(arg_max(volume, t), 6) AS last_volume, round(avg(volume) FILTER (WHERE rn > n - 20), 6) AS avg_volume FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY symbol")
def _(v):
    df = v.bars.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    return df.groupBy("symbol").agg(F.round(F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")) / F.sum("volume"), 6).alias("vwap"), F.round(F.max_by("volume", "t"), 6).alias("last_volume"), F.round(F.avg(F.when(F.col("rn") > F.col("n") - 20, F.col("volume"))), 6).alias("avg_volume"))


@query("a19_close_profile", "WITH RECURSIVE " + BARS + """, e AS (SELECT symbol, min(close) AS lo, max(close) AS hi, sum(volume) AS total FROM bars GROUP BY 1),
g AS (SELECT b.symbol, least(floor((close - lo) / ((hi - lo) / 24))::INT, 23) AS bin, sum(volume) AS vol FROM bars b JOIN e USING (symbol) GROUP BY 1, 2),
l AS (SELECT symbol, list(coalesce(vol, 0.0) ORDER BY n) AS vols FROM (SELECT e.symbol, n, vol FROM e CROSS JOIN range(24) r(n) LEFT JOIN g ON g.symbol = e.symbol AND g.bin = n) GROUP BY 1),
p AS (SELECT symbol, vols, list_position(vols, list_max(vols)) AS peak FROM l),
x AS (SELECT symbol, vols, total, peak, peak AS a, peak AS z, vols[peak] AS got, 0 AS step FROM p JOIN e USING (symbol)
  UNION ALL SELECT symbol, vols, total, peak, CASE WHEN right_ >= left_ THEN a ELSE a - 1 END, CASE WHEN right_ >= left_ THEN z + 1 ELSE z END, got + greatest(left_, right_), step + 1
  FROM (SELECT *, CASE WHEN a > 1 THEN vols[a - 1] ELSE -1 END AS left_, CASE WHEN z < 24 THEN vols[z + 1] ELSE -1 END AS right_ FROM x) WHERE got < 0.7 * total AND (a > 1 OR z < 24)),
f AS (SELECT symbol, arg_max(peak, step) AS peak, arg_max(a, step) AS a, arg_max(z, step) AS z FROM x GROUP BY 1)
SELECT symbol, round(lo + (peak - 0.5) * (hi - lo) / 24, 6) AS poc, round(lo + (a - 0.5) * (hi - lo) / 24, 6) AS value_area_low, round(lo + (z - 0.5) * (hi - lo) / 24, 6) AS value_area_high, total AS total_volume FROM f JOIN e USING (symbol)""")
def _(v):
    return V.close_profile(v.bars)


@query("a20_range_profile", B + ", e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1), w AS (SELECT b.symbol, b.volume, lo, (hi - lo) / 24 AS width, greatest(0, least(23, floor((low - lo) / ((hi - lo) / 24))::INT)) AS a, greatest(0, least(23, floor((high - lo) / ((hi - lo) / 24))::INT)) AS z FROM bars b JOIN e USING (symbol)), x AS (SELECT symbol, lo, width, unnest(range(a, z + 1)) AS bin, volume / (z - a + 1) AS vol, 1.0::DOUBLE / (z - a + 1) AS tim FROM w), g AS (SELECT symbol, lo, width, bin, round(sum(vol), 6) AS vol, round(sum(tim), 6) AS tim FROM x GROUP BY ALL), c AS (SELECT *, sum(vol) OVER (PARTITION BY symbol ORDER BY vol DESC, bin ROWS UNBOUNDED PRECEDING) - vol AS ahead, sum(vol) OVER (PARTITION BY symbol) AS total FROM g) SELECT symbol, round(arg_max(lo + (bin + 0.5) * width, (vol, -bin)), 4) AS poc, round(arg_max(lo + (bin + 0.5) * width, (tim, -bin)), 4) AS tpo_poc, round(min(lo + bin * width) FILTER (WHERE ahead < 0.7 * total), 4) AS val, round(max(lo + (bin + 1) * width) FILTER (WHERE ahead < 0.7 * total), 4) AS vah FROM c GROUP BY symbol")
def _(v):
    return V.range_profile(v.bars)


@query("a21_walls", "WITH " + BOOK + " SELECT snap, side, price, size FROM book QUALIFY row_number() OVER (PARTITION BY snap, side ORDER BY size DESC, price) <= 2")
def _(v):
    k = F.row_number().over(Window.partitionBy("snap", "side").orderBy(F.desc("size"), "price"))
    return v.book.withColumn("k", k).where("k <= 2").select("snap", "side", "price", "size")


TIERS = [(100, 0.05), (50, 0.10), (25, 0.18), (20, 0.15), (10, 0.22), (5, 0.18), (3, 0.12)]
LEVELS = ", tiers(lev, share) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in TIERS) + """),
lv AS (SELECT exchange, side, lev, round(mark * (1 + CASE side WHEN 'long' THEN -1 ELSE 1 END / lev), 2) AS price, round(CASE side WHEN 'long' THEN -1 ELSE 1 END / lev * 100, 2) AS distance_pct, oi_usd * share * CASE side WHEN 'long' THEN ls ELSE 1 - ls END AS notional
  FROM (SELECT *, greatest(0.2, least(0.8, 0.5 + funding * 500)) AS ls FROM venues), tiers, (VALUES ('long'), ('short')) s(side))"""


@query("a21_liquidation_levels", VE + LEVELS + " SELECT exchange, side, lev AS leverage, price, distance_pct, round(notional, 2) AS notional FROM lv")
def _(v):
    return V.liquidation_levels(v.venues, TIERS).select("exchange", "side", "leverage", "price", "distance_pct", F.round("notional", 2).alias("notional"))


@query("a21_liquidation_skew", VE + LEVELS + " SELECT exchange, round((sum(CASE side WHEN 'short' THEN w ELSE 0 END) - sum(CASE side WHEN 'long' THEN w ELSE 0 END)) / sum(w), 6) AS net FROM (SELECT *, notional / (1 + abs(distance_pct)) AS w FROM lv WHERE abs(distance_pct) <= 8) GROUP BY 1")
def _(v):
    return V.liquidation_skew(V.liquidation_levels(v.venues, TIERS))


@query("a21_cluster_map", VE + LEVELS + ", b AS (SELECT exchange, round_even(distance_pct / 5, 0) * 5 AS bucket_pct, round(sum(notional), 2) AS notional FROM lv GROUP BY 1, 2) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY notional DESC, bucket_pct) <= 8")
def _(v):
    return V.cluster_map(V.liquidation_levels(v.venues, TIERS), 5.0, 8)


@query("a22_cumulative_delta", T + " SELECT symbol, event_id, round(sum(CASE side WHEN 'buy' THEN size ELSE -size END) OVER (PARTITION BY symbol ORDER BY t, event_id), 4) AS cvd FROM tape")
def _(v):
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    return running_sum(v.tape, signed, "cvd", ("symbol",), ("t", "event_id"), 86_400).select("symbol", "event_id", F.round("cvd", 4).alias("cvd"))


@query("a22_book_imbalance", "WITH " + BOOK + ", k AS (SELECT *, row_number() OVER (PARTITION BY snap, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS k FROM book), g AS (SELECT snap, sum(CASE side WHEN 'bid' THEN size ELSE 0 END) AS b, sum(CASE side WHEN 'ask' THEN size ELSE 0 END) AS a FROM k WHERE k <= 5 GROUP BY 1) SELECT snap, round((b - a) / (b + a), 6) AS imbalance FROM g")
def _(v):
    return V.book_imbalance(v.book, 5)


@query("a23_microstructure_summary", T + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC, event_id DESC) AS k, max(t) OVER (PARTITION BY symbol) AS last_t FROM tape) SELECT symbol, count(*) AS n, round(avg(price), 4) AS mid, round((sum(CASE side WHEN 'buy' THEN size ELSE 0 END) - sum(CASE side WHEN 'sell' THEN size ELSE 0 END)) / sum(size), 6) AS trade_sign, max(last_t) >= (SELECT max(t) FROM tape) - 120 AS fresh FROM k WHERE k <= 60 GROUP BY symbol")
def _(v):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("event_id")))
    s = v.tape.withColumn("k", k).where("k <= 60")
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    g = s.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mid"), F.round(F.sum(signed) / F.sum("size"), 6).alias("trade_sign"), F.max("t").alias("last_t"))
    return g.select("symbol", "n", "mid", "trade_sign", (F.col("last_t") >= F.max("last_t").over(Window.partitionBy()) - 120).alias("fresh"))  # a row for each symbol


@query("a24_scan_cycles", "WITH RECURSIVE " + EV + ", o AS (SELECT 'S' || (user_id % 8) AS symbol, sec AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY sec, event_id) AS rn FROM ev), c AS (SELECT symbol, t, rn, t AS start, 0::BIGINT AS cycle FROM o WHERE rn = 1 UNION ALL SELECT o.symbol, o.t, o.rn, CASE WHEN o.t - c.start > 3600 THEN o.t ELSE c.start END, c.cycle + CASE WHEN o.t - c.start > 3600 THEN 1 ELSE 0 END FROM c JOIN o ON o.symbol = c.symbol AND o.rn = c.rn + 1) SELECT symbol, cycle, min(t) AS t, count(*) AS n FROM c GROUP BY 1, 2")
def _(v):
    df = v.events.select(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.col("sec").alias("t"), "event_id")
    return P.per_series(df, lambda g: {"cycle": P.gap_cycles(g["t"].to_numpy(), 3600)}, "cycle long", order=("t", "event_id")).groupBy("symbol", "cycle").agg(F.min("t").alias("t"), F.count("*").alias("n"))


@query("a25_market_timing", VO + ", c AS (SELECT agent, t, avg(vote) AS v FROM votes GROUP BY ALL), p AS (SELECT DISTINCT symbol, t, price FROM votes), d AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM votes)), f AS (SELECT a.t, avg(b.price / a.price - 1) AS fwd FROM p a JOIN d x ON a.t = x.t JOIN d y ON y.k = x.k + 3 JOIN p b ON b.symbol = a.symbol AND b.t = y.t WHERE (x.k - 1) % 3 = 0 GROUP BY a.t) SELECT agent, t, round(v, 9) AS vote, round(fwd, 6) AS fwd FROM c JOIN f USING (t)")
def _(v):
    votes = v.votes
    prices = votes.select("symbol", "t", "price").distinct()
    days = votes.select("t").distinct().withColumn("k", F.row_number().over(Window.orderBy("t")))  # a row a day
    days = days.withColumn("later", F.lead("t", 3).over(Window.orderBy("t"))).where("(k - 1) % 3 = 0 and later is not null")
    later = prices.select(F.col("symbol").alias("s"), F.col("t").alias("later"), F.col("price").alias("p1"))
    fwd = prices.join(days, "t").join(later, "later").where("symbol = s").groupBy("t").agg(F.avg(F.col("p1") / F.col("price") - 1).alias("fwd"))
    mean = votes.groupBy("agent", "t").agg(F.avg("vote").alias("v"))
    return mean.join(fwd, "t").select("agent", "t", F.round("v", 9).alias("vote"), F.round("fwd", 6).alias("fwd"))


@query("a26_cost_per_day", "WITH " + EV + " SELECT sec // 86400 AS day, count(*) AS calls, round(sum(value * 0.001), 6) AS cost, sum(value * 0.001) > 5 AS over_budget FROM ev WHERE event_type = 'click' GROUP BY 1")
def _(v):
    cost = F.sum(F.col("value") * 0.001)
    return v.events.where("event_type = 'click'").groupBy(F.floor(F.col("sec") / 86400).alias("day")).agg(F.count("*").alias("calls"), F.round(cost, 6).alias("cost"), (cost > 5).alias("over_budget"))


@query("a27_rate_percentile", B + ", l AS (SELECT symbol, arg_max(close, t) AS last, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, CASE WHEN max(n) >= 90 THEN round(avg((close <= last)::INT), 6) END AS percentile FROM bars JOIN l USING (symbol) GROUP BY symbol")
def _(v):
    last = v.bars.groupBy("symbol").agg(F.max_by("close", "t").alias("last"), F.count("*").alias("n"))
    return v.bars.join(last, "symbol").groupBy("symbol").agg(F.when(F.max("n") >= 90, F.round(F.avg((F.col("close") <= F.col("last")).cast("int")), 6)).alias("percentile"))


@query("a28_status_counts", J + " SELECT status, count(*) AS n, count(*) FILTER (WHERE implied_leverage > 2) AS over_leverage FROM journal GROUP BY 1")
def _(v):
    return v.journal.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("implied_leverage") > 2).alias("over_leverage"))


@query("a31_consensus", VO + " SELECT symbol, t, round(sum(vote * confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END) / nullif(sum(confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END), 0), 9) AS consensus, CASE WHEN round(sum(vote * confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END) / nullif(sum(confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END), 0), 9) > 0.2 THEN 'LONG' WHEN round(sum(vote * confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END) / nullif(sum(confidence * CASE agent WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE 1 END), 0), 9) < -0.2 THEN 'SHORT' ELSE 'NEUTRE' END AS bias FROM votes GROUP BY ALL")
def _(v):
    from ..operators.ensemble import consensus

    weight = F.when(F.col("agent") == "click", 0.5).when(F.col("agent") == "view", 1.5).otherwise(1.0)
    return consensus(v.votes.withColumn("weight", weight)).select("symbol", "t", F.round("consensus", 9).alias("consensus"), "bias")


@query("a32_situation_expectancy", "WITH " + EV + " SELECT event_type, round(sum(value * w) / sum(w), 6) AS expectancy, count(*) AS n FROM (SELECT event_type, value, (1 + user_id % 3) / 3.0::DOUBLE AS w FROM ev) GROUP BY 1 HAVING count(*) >= 3")
def _(v):
    w = (1 + F.col("user_id") % 3) / 3.0
    return v.events.groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("expectancy"), F.count("*").alias("n")).where("n >= 3")


@query("w25_r_multiples", O + " SELECT signal_id, CASE outcome WHEN 'TP TOUCHÉ' THEN round(abs(take_profit - entry) / nullif(abs(entry - stop_loss), 0), 4) WHEN 'SL TOUCHÉ' THEN -1.0 ELSE 0.0 END AS r FROM o")
def _(v):
    risk = F.abs(F.col("entry") - F.col("stop_loss"))
    r = F.when(F.col("outcome") == FINAL[0], F.when(risk > 0, F.round(F.abs(F.col("take_profit") - F.col("entry")) / risk, 4))).when(F.col("outcome") == FINAL[1], -1.0).otherwise(0.0)
    return outcomes(v).select("signal_id", r.alias("r"))


@query("w23_equity_curve", O + ", r AS (SELECT symbol, t, CASE outcome WHEN 'TP TOUCHÉ' THEN 2.0 WHEN 'SL TOUCHÉ' THEN -1.0 ELSE 0.0 END AS r FROM o) SELECT symbol, t, round(100 * exp(sum(ln(1 + r * 0.01)) OVER (PARTITION BY symbol ORDER BY t)), 6) AS equity FROM r")
def _(v):
    r = F.when(F.col("outcome") == FINAL[0], 2.0).when(F.col("outcome") == FINAL[1], -1.0).otherwise(0.0)
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return outcomes(v).select("symbol", "t", F.round(100 * F.exp(F.sum(F.log(1 + r * 0.01)).over(w)), 6).alias("equity"))


@query("w34_order_flow", T + ", s AS (SELECT symbol, (t // 3600) * 3600 AS t, round(avg(price) FILTER (WHERE side = 'buy'), 4) AS bp, sum(size) FILTER (WHERE side = 'buy') AS bq, round(avg(price) FILTER (WHERE side = 'sell'), 4) AS ap, sum(size) FILTER (WHERE side = 'sell') AS aq FROM tape GROUP BY ALL HAVING count(DISTINCT side) = 2), l AS (SELECT *, lag(bp) OVER w AS bp0, lag(bq) OVER w AS bq0, lag(ap) OVER w AS ap0, lag(aq) OVER w AS aq0 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, t, round(CASE WHEN bp0 IS NULL THEN 0 ELSE CASE WHEN bp > bp0 THEN bq WHEN bp = bp0 THEN bq - bq0 ELSE -bq0 END - CASE WHEN ap > ap0 THEN -aq0 WHEN ap = ap0 THEN aq - aq0 ELSE aq END END, 4) AS ofi FROM l")
def _(v):
    from ..operators.microstructure import order_flow

    buy = F.col("side") == "buy"
    s = v.tape.groupBy("symbol", (F.floor(F.col("t") / 3600) * 3600).alias("t")).agg(F.round(F.avg(F.when(buy, F.col("price"))), 4).alias("bid"), F.sum(F.when(buy, F.col("size"))).alias("bid_size"), F.round(F.avg(F.when(~buy, F.col("price"))), 4).alias("ask"), F.sum(F.when(~buy, F.col("size"))).alias("ask_size")).where("bid is not null and ask is not null")
    return order_flow(s).select("symbol", "t", F.round("ofi", 4).alias("ofi"))
