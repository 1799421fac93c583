"""Projections, predicates, scalar families and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import guards as G
from ..functions import scalars as S
from ..operators import folds as P
from ..operators import windows as W
from .q_windows import B, BY, R, RSI, TR, ema_sql, frame
from .registry import query
from .views import BOOK, EV, JOURNAL, SIGNALS, VENUES, VOTES

E = "WITH " + EV
J = "WITH " + JOURNAL


@query("p1_safe_float", J + " SELECT event_id, try_cast(nullif(trim(replace(rsi, ',', '.')), '') AS DOUBLE) AS rsi, try_cast(nullif(trim(replace(' ' || replace(rsi, '.', ','), ',', '.')), '') AS DOUBLE) AS from_comma, try_cast(symbol AS DOUBLE) AS none FROM journal")
def _(v):
    comma = F.concat(F.lit(" "), F.replace(F.col("rsi"), F.lit("."), F.lit(",")))
    return v.journal.select("event_id", S.safe_float(F.col("rsi")).alias("rsi"), S.safe_float(comma).alias("from_comma"), S.safe_float(F.col("symbol")).alias("none"))


@query("p2_first_filled", J + " SELECT event_id, coalesce(nullif(rsi, ''), nullif(ranking, ''), nullif(symbol, '')) AS filled FROM journal")
def _(v):
    return v.journal.select("event_id", S.first_filled(F.col("rsi"), F.col("ranking"), F.col("symbol")).alias("filled"))


@query("p3_side", "SELECT doc_id, CASE WHEN lower(text) SIMILAR TO '(?s).*(long|buy).*' THEN 'LONG' WHEN lower(text) SIMILAR TO '(?s).*(short|sell).*' THEN 'SHORT' ELSE 'UNKNOWN' END AS side FROM documents")
def _(v):
    return v.table("documents").select("doc_id", S.side_of("text").alias("side"))


@query("p4_symbol_split", "WITH s AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || CASE p_partkey % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDC' WHEN 2 THEN 'USD' ELSE 'EUR' END AS s FROM part) SELECT p_partkey, CASE WHEN s LIKE '%USDT' OR s LIKE '%USDC' THEN left(s, -4) WHEN s LIKE '%USD' THEN left(s, -3) ELSE s END AS base, CASE WHEN s LIKE '%USDT' THEN 'USDT' WHEN s LIKE '%USDC' THEN 'USDC' WHEN s LIKE '%USD' THEN 'USD' ELSE '' END AS quote FROM s")
def _(v):
    k = F.col("p_partkey") % 4
    s = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.when(k == 0, "USDT").when(k == 1, "USDC").when(k == 2, "USD").otherwise("EUR"))
    base, quote = S.split_symbol(F.col("s"))
    return v.table("part").select("p_partkey", s.alias("s")).select("p_partkey", base.alias("base"), quote.alias("quote"))


@query("p5_granularity", "SELECT g, CASE WHEN regexp_matches(g, '^[0-9]+[hdw]$') THEN upper(g) ELSE g END AS normal FROM (SELECT DISTINCT (o_orderkey % 30) || CASE o_orderkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'h' WHEN 2 THEN 'd' WHEN 3 THEN 'M' ELSE 'w' END AS g FROM orders)")
def _(v):
    k = F.col("o_orderkey")
    g = F.concat((k % 30).cast("string"), F.when(k % 5 == 0, "m").when(k % 5 == 1, "h").when(k % 5 == 2, "d").when(k % 5 == 3, "M").otherwise("w"))
    return v.table("orders").select(g.alias("g")).distinct().select("g", S.granularity(F.col("g")).alias("normal"))


@query("p6_quote_guards", "WITH " + BOOK + ", q AS (SELECT snap, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask, (snap * 37) % 5000 - 100 AS age FROM book GROUP BY 1) SELECT snap, coalesce(bid > 0 AND ask >= bid, false) AS valid, age BETWEEN 0 AND 2500 AS fresh FROM q")
def _(v):
    q = v.book.groupBy("snap").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    c = D.quote_checks(F.col("bid"), F.col("ask"), (F.col("snap") * 37) % 5000 - 100)
    return q.select("snap", c["valid"].alias("valid"), c["fresh"].alias("fresh"))


@query("p6_series_ok", B + f", x AS (SELECT *, abs(close / lag(close) OVER {BY} - 1) AS jump FROM bars) SELECT symbol, count(*) >= 2 AND min(close) > 0 AND coalesce(max(jump), 0) <= 0.8 AS ok, count(*) FILTER (WHERE jump > 0.8) AS jumps FROM x GROUP BY 1")
def _(v):
    df = v.bars.withColumn("jump", F.abs(F.try_divide("close", W.lag("close")) - 1)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("m"), F.max("jump").alias("j"), F.count_if(F.col("jump") > 0.8).alias("jumps"))
    return df.select("symbol", ((F.col("n") >= 2) & (F.col("m") > 0) & (F.coalesce("j", F.lit(0.0)) <= 0.8)).alias("ok"), "jumps")


DEC = "CASE event_id % 5 WHEN 0 THEN 'LONG POSSIBLE' WHEN 1 THEN 'BIAIS LONG' WHEN 2 THEN 'SHORT POSSIBLE' WHEN 3 THEN 'BIAIS SHORT' ELSE 'NEUTRE' END"
REG = "CASE user_id % 3 WHEN 0 THEN 'risk_on' WHEN 1 THEN 'risk_off' ELSE 'x' END"


@query("p7_regime_gate", E + f", x AS (SELECT event_id, {DEC} AS d, CASE WHEN value <= 20 THEN 'RISK_OFF' WHEN value >= 80 THEN 'RISK_ON' WHEN user_id % 3 = 0 THEN 'RISK_ON' WHEN user_id % 3 = 1 THEN 'RISK_OFF' ELSE 'NEUTRE' END AS regime FROM ev) SELECT event_id, regime, CASE WHEN regime = 'RISK_OFF' AND d LIKE '%LONG%' THEN 'NEUTRE' WHEN regime = 'RISK_ON' AND d LIKE '%SHORT%' THEN 'NEUTRE' ELSE d END AS decision FROM x")
def _(v):
    df = v.events.select("event_id", F.expr(DEC).alias("d"), D.effective_regime(F.expr(REG), F.col("value")).alias("regime"))
    return df.select("event_id", "regime", D.gated(F.col("d"), F.col("regime")).alias("decision"))


@query("p8_invalidation", "WITH " + VOTES + " SELECT symbol, t, agent, price < 45 OR price > 60 AS invalidated, CASE WHEN price < 45 OR price > 60 THEN 0.0 ELSE confidence END AS confidence FROM votes")
def _(v):
    from ..operators.ensemble import invalidate

    return invalidate(v.votes.withColumn("invalid_below", F.lit(45.0)).withColumn("invalid_above", F.lit(60.0))).select("symbol", "t", "agent", "invalidated", "confidence")


@query("p9_watch_list", "WITH " + VOTES + " SELECT agent, round(sum(CASE WHEN agent IN ('error', 'signup') THEN 0.0 ELSE 1.0 END * confidence), 4) AS weight FROM votes GROUP BY 1")
def _(v):
    w = F.when(F.col("agent").isin("error", "signup"), 0.0).otherwise(1.0)
    return v.votes.groupBy("agent").agg(F.round(F.sum(w * F.col("confidence")), 4).alias("weight"))


LIMITS = {"daily_loss": 20.0, "positions": 8, "notional": 80.0, "leverage": 3.0}


@query("p10_check_trade", E + " SELECT event_id, CASE WHEN user_id % 50 = 0 THEN 'kill' WHEN user_id % 40 >= 20 AND user_id % 7 = 0 THEN 'daily_loss' WHEN user_id % 10 >= 8 THEN 'positions' WHEN value <= 0 THEN 'notional' WHEN value > 80 THEN 'size' WHEN (event_id % 40) / 10.0 <= 0 THEN 'leverage' WHEN (event_id % 40) / 10.0 > 3 THEN 'max_leverage' ELSE 'OK' END AS reason FROM ev")
def _(v):
    loss = F.when(F.col("user_id") % 7 == 0, (F.col("user_id") % 40).cast("double")).otherwise(0.0)
    return v.events.select("event_id", D.check_trade(F.col("value"), (F.col("event_id") % 40) / 10.0, loss, F.col("user_id") % 10, F.col("user_id") % 50 == 0, LIMITS).alias("reason"))


@query("p11_guard_reasons", E + ", x AS (SELECT event_id, value, user_id % 4 = 0 AS reduce, user_id % 11 = 0 AS kill, (event_id % 70) / 10.0 AS lev, (user_id % 30)::DOUBLE AS gross, (event_id % 25)::DOUBLE AS dd, (sec // 3600) % 24 AS h FROM ev) SELECT event_id, array_to_string(list_filter([CASE WHEN kill AND NOT reduce THEN 'kill' END, CASE WHEN lev <= 0 THEN 'leverage' END, CASE WHEN lev > 5 THEN 'max_leverage' END, CASE WHEN value <= 0 THEN 'notional' END, CASE WHEN NOT reduce AND value > 50 THEN 'per_trade' END, CASE WHEN NOT reduce AND gross + value > 75 THEN 'gross' END, CASE WHEN dd >= 20 THEN 'drawdown' END, CASE WHEN NOT (h >= 7 AND h < 21) THEN 'session' END], lambda y: y IS NOT NULL), ',') AS reasons FROM x")
def _(v):
    hour = F.floor(F.col("sec") / 3600) % 24
    no, yes = F.lit(False), F.lit(True)
    why = D.guard_reasons(F.col("user_id") % 11 == 0, yes, yes, (F.col("event_id") % 70) / 10.0, F.col("value"), (F.col("user_id") % 30).cast("double"), (F.col("event_id") % 25).cast("double"), (hour >= 7) & (hour < 21), no, no, F.col("user_id") % 4 == 0, {"leverage": 5.0, "per_trade": 50.0, "gross": 75.0, "drawdown": 20.0})
    return v.events.select("event_id", F.array_join(why, ",").alias("reasons"))


@query("p12_mandate_gate", E + " SELECT event_id, value <= 60 AND user_id % 9 <> 0 AS ok, CASE WHEN user_id % 9 = 0 THEN 'frozen' WHEN value > 60 THEN 'cap' ELSE '' END AS block, CASE WHEN value > 45 THEN 'near_cap' ELSE '' END AS note FROM ev")
def _(v):
    frozen, over = F.col("user_id") % 9 == 0, F.col("value") > 60
    return v.events.select("event_id", (~over & ~frozen).alias("ok"), F.when(frozen, "frozen").when(over, "cap").otherwise("").alias("block"), F.when(F.col("value") > 45, "near_cap").otherwise("").alias("note"))


@query("p13_sessions", E + ", m AS (SELECT event_id, sec, (sec // 60) % 1440 AS m FROM ev) SELECT event_id, array_to_string(list_filter([CASE WHEN m >= 540 AND m < 660 THEN 'EU_MORNING' END, CASE WHEN m >= 930 AND m < 1020 THEN 'US_OPEN' END, CASE WHEN m >= 930 AND m < 990 THEN 'US_OPEN_PEAK' END, CASE WHEN m >= 60 AND m < 120 THEN 'ASIA_LATE' END], lambda y: y IS NOT NULL), ',') AS sessions, (sec // 28800 + 1) * 28800 - sec <= 1200 AS defer_funding FROM m")
def _(v):
    minute = F.floor(F.col("sec") / 60) % 1440
    return v.events.select("event_id", D.sessions(minute).alias("sessions"), ((F.floor(F.col("sec") / 28800) + 1) * 28800 - F.col("sec") <= 1200).alias("defer_funding"))


@query("p13_macro_blackout", E + ", a AS (SELECT sec AS tt FROM ev WHERE event_id % 500 = 0) SELECT event_id, EXISTS (SELECT 1 FROM a WHERE ev.sec BETWEEN tt - 1800 AND tt + 900) AS blackout FROM ev")
def _(v):
    """Events within 30 minutes before or 15 after an announcement: announcements are dealt to the slices they cover."""
    at = v.events.where("event_id % 500 = 0").select(F.explode(F.sequence(F.floor((F.col("sec") - 1800) / 3600), F.floor((F.col("sec") + 900) / 3600))).alias("slice"), F.col("sec").alias("at"))
    e = v.events.withColumn("slice", F.floor(F.col("sec") / 3600))
    hit = e.join(at, "slice").where("sec between at - 1800 and at + 900").select("event_id").distinct().withColumn("hit", F.lit(True))
    return e.select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("blackout"))


@query("p14_watch_verdict", E + ", l AS (SELECT event_type, max(sec) AS t, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, CASE WHEN n < 100 THEN 'STOPPED' WHEN (SELECT max(sec) FROM ev) - t > 900 THEN 'STALE' ELSE 'OK' END AS verdict FROM l")
def _(v):
    g = v.events.groupBy("event_type").agg(F.max("sec").alias("t"), F.count("*").alias("n"))
    newest = F.max("t").over(Window.partitionBy())
    return g.select("event_type", F.when(F.col("n") < 100, "STOPPED").when(newest - F.col("t") > 900, "STALE").otherwise("OK").alias("verdict"))


TITLE = "CASE p_partkey % 6 WHEN 0 THEN 'Will delist ' WHEN 1 THEN 'Trading suspended: ' WHEN 2 THEN 'System upgrade for ' WHEN 3 THEN 'New listing ' WHEN 4 THEN 'Will remove (' ELSE 'News on ' END || upper(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 2 = 0 THEN 'USDT pair' ELSE ' soon' END"


@query("p15_announcements", f"WITH x AS (SELECT p_partkey, {TITLE} AS t FROM part), k AS (SELECT *, CASE WHEN regexp_matches(lower(t), 'delist|will remove|will no longer') THEN 'delisting' WHEN regexp_matches(lower(t), 'suspen|halt|pause trading') THEN 'suspension' WHEN regexp_matches(lower(t), 'maintenance|system upgrade') THEN 'maintenance' WHEN contains(lower(t), 'list') THEN 'listing' ELSE 'other' END AS kind FROM x) SELECT p_partkey, kind, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(t), '\\b([A-Z0-9]{{2,15}}USDT)\\b', 1))), ',') AS symbols FROM k")
def _(v):
    df = v.table("part").select("p_partkey", F.expr(TITLE.replace("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)")).alias("t"))
    found = F.regexp_extract_all(F.upper("t"), F.lit(r"\b([A-Z0-9]{2,15}USDT)\b"), F.lit(1))
    return df.select("p_partkey", D.announcement_kind(F.col("t")).alias("kind"), F.array_join(F.sort_array(F.array_distinct(found)), ",").alias("symbols"))


@query("p16_prompt_guard")
def _(v):
    c = v.table("conversations")
    s = G.scan(F.col("text"))
    return c.select("conv_id", "turn", s["risk"].alias("risk"), s["hits"].alias("hits"), F.length(G.sanitize(F.col("text"))).alias("clean_length"), (G.redact(F.col("text")) != F.col("text")).alias("redacted"))


_SCAN = ", ".join("CASE WHEN regexp_matches(t, '" + "|".join(f"(?:{x})" for x in pats).replace("'", "''") + f"') THEN '{tag}' END" for tag, pats in sorted(G.SIGNS.items()))


@query("p16_prompt_scan", f"WITH x AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), h AS (SELECT conv_id, turn, list_filter([{_SCAN}], lambda y: y IS NOT NULL) AS h FROM x) SELECT conv_id, turn, array_to_string(h, ',') AS hits, CASE WHEN len(h) >= 2 OR list_has_any(h, ['override', 'exfil', 'secret', 'jailbreak']) THEN 'high' WHEN len(h) = 1 THEN 'medium' ELSE 'low' END AS risk FROM h")
def _(v):
    s = G.scan(F.col("text"))
    return v.table("conversations").select("conv_id", "turn", s["hits"].alias("hits"), s["risk"].alias("risk"))


@query("p16_secret_scan", r"SELECT doc_id, regexp_matches(lower(text), 'api[_ ]?key|secret|password|passphrase|private key|seed phrase|bearer token|clé api|mot de passe') AS mentions FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.lower("text").rlike(G.SIGNS["secret"][0]).alias("mentions"))


@query("p17_risk_profile", "SELECT c_custkey, c_custkey % 6 AS level, coalesce(x::DOUBLE, 0.0::DOUBLE) AS leverage, coalesce(c_custkey % 6 BETWEEN 1 AND 3, false) AS ok FROM customer LEFT JOIN (VALUES (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)) p(l, x) ON l = c_custkey % 6")
def _(v):
    prof = v.spark.createDataFrame([(k, float(k)) for k in range(1, 6)], "level long, leverage double")
    df = v.table("customer").select("c_custkey", (F.col("c_custkey") % 6).alias("level")).join(F.broadcast(prof), "level", "left")  # five rows
    return df.select("c_custkey", "level", F.coalesce("leverage", F.lit(0.0)).alias("leverage"), F.col("level").between(1, 3).alias("ok"))


@query("p18_notes_query", "SELECT count(*) AS n, min(doc_id) AS first FROM documents WHERE lang = 'en' AND contains(lower(text), 'license')")
def _(v):
    return v.table("documents").where((F.col("lang") == "en") & F.lower("text").contains("license")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("p19_rising_edge", B + f", x AS (SELECT symbol, t, close > 50 AS now, coalesce(lag(close) OVER {BY} > 50, false) AS was FROM bars) SELECT symbol, t FROM x WHERE now AND NOT was")
def _(v):
    hot = F.col("close") > 50
    return v.bars.where("true").select("symbol", "t", hot.alias("now"), F.coalesce(W.lag("close") > 50, F.lit(False)).alias("was")).where("now and not was").select("symbol", "t")


@query("p20_config_checks", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'low' END, CASE WHEN p_size > 45 THEN 'high' END, CASE WHEN p_retailprice <= 0 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS problems FROM part WHERE p_size < 5 OR p_size > 45 OR p_retailprice <= 0")
def _(v):
    why = S.reasons(("low", F.col("p_size") < 5), ("high", F.col("p_size") > 45), ("price", F.col("p_retailprice") <= 0))
    return v.table("part").select("p_partkey", why.alias("w")).where(F.size("w") > 0).select("p_partkey", F.array_join("w", ",").alias("problems"))


OPT = B + ", o AS (SELECT symbol, t, close AS s, round(close * 1.1, 6) AS k, 0.02::DOUBLE AS v, 20.0::DOUBLE AS m FROM bars), d AS (SELECT *, (ln(s / k) + 0.5 * v * v * m) / (v * sqrt(m)) AS d1, (ln(s / k) + 0.5 * v * v * m) / (v * sqrt(m)) - v * sqrt(m) AS d2 FROM o)"


@query("f1_options", OPT + f" SELECT symbol, t, round(s * {S.normal_cdf_sql('d1')} - k * {S.normal_cdf_sql('d2')}, 6) AS call, round(k * {S.normal_cdf_sql('(-d2)')} - s * {S.normal_cdf_sql('(-d1)')}, 6) AS put, round({S.normal_cdf_sql('d1')}, 6) AS delta, round(exp(-0.5 * d1 * d1) / sqrt(2 * pi()) / (s * v * sqrt(m)), 6) AS gamma, round(s * exp(-0.5 * d1 * d1) / sqrt(2 * pi()) * sqrt(m), 6) AS vega, round(least(1, 2 * {S.normal_cdf_sql('d2')}), 6) AS touch FROM d")
def _(v):
    df = v.bars.select("symbol", "t", "close", F.round(F.col("close") * 1.1, 6).alias("strike"), F.lit(0.02).alias("sigma"), F.lit(20.0).alias("term"))
    return S.options(df, "close", "strike", "sigma", "term").select("symbol", "t", *[F.round(n, 6).alias(n) for n in ("call", "put", "delta", "gamma", "vega", "touch")])


@query("f1_inverse_normal", "WITH p AS (SELECT i, i / 100.0::DOUBLE AS p FROM range(1, 100) r(i)), x AS (SELECT *, 2 * p - 1 AS y, ln(1 - (2 * p - 1) * (2 * p - 1)) AS l FROM p), z AS (SELECT *, 2 / (pi() * 0.147) + l / 2 AS a FROM x) SELECT i, round(CASE WHEN y = 0 THEN 0 ELSE sqrt(2) * sign(y) * sqrt(sqrt(a * a - l / 0.147) - a) END, 6) AS z FROM z")
def _(v):
    p = F.col("id") / 100.0
    return v.spark.range(1, 100).select(F.col("id").alias("i"), F.round(F.when(F.col("id") == 50, 0.0).otherwise(S.inverse_normal(p)), 6).alias("z"))


@query("f2_position_size", "WITH " + SIGNALS + " SELECT signal_id, round(1000.0 * 1.0 / 100 / abs(entry - stop_loss), 6) AS size, round(greatest(1, least(5, 1 + 4 * greatest(0, least(1, entry / 100)) * least(1, 0.02 / greatest(risk / entry / 4, 0.000001)))), 2) AS leverage FROM signals")
def _(v):
    size = S.risk_size(F.lit(1000.0), F.lit(1.0), F.col("entry"), F.col("stop_loss"))
    return v.signals.select("signal_id", F.round(size, 6).alias("size"), D.target_leverage(F.col("entry") / 100, F.col("risk") / F.col("entry") / 4).alias("leverage"))


@query("f2_kelly", E + ", g AS (SELECT event_type, avg((value > 40)::INT) AS w, avg(value) FILTER (WHERE value > 40) / avg(value) FILTER (WHERE value <= 40) AS r FROM ev GROUP BY 1) SELECT event_type, round(w, 6) AS win, round(r, 6) AS payoff, round(greatest(0, least(0.25, 0.5 * (w - (1 - w) / r))), 6) AS kelly FROM g")
def _(v):
    hot = F.col("value") > 40
    g = v.events.groupBy("event_type").agg(F.avg(hot.cast("int")).alias("w"), (F.avg(F.when(hot, F.col("value"))) / F.avg(F.when(~hot, F.col("value")))).alias("r"))
    return g.select("event_type", F.round("w", 6).alias("win"), F.round("r", 6).alias("payoff"), F.round(S.kelly(F.col("w"), F.col("r")), 6).alias("kelly"))


@query("f2_stress", "WITH " + VENUES + " SELECT exchange, round(oi_usd * 0.2, 2) AS loss, round(mark * 1000 - oi_usd * 0.2, 2) AS equity_after, oi_usd * 0.2 >= mark * 1000 * 0.05 AS breach FROM venues")
def _(v):
    loss = F.col("oi_usd") * 0.2
    return v.venues.select("exchange", F.round(loss, 2).alias("loss"), F.round(F.col("mark") * 1000 - loss, 2).alias("equity_after"), (loss >= F.col("mark") * 1000 * 0.05).alias("breach"))


@query("f3_actions", "WITH " + VOTES + ", c AS (SELECT symbol, t, round(sum(vote * confidence) / sum(confidence), 9) AS c FROM votes GROUP BY ALL), s AS (SELECT *, CASE (t // 86400) % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' END AS held FROM c) SELECT symbol, t, CASE WHEN held IS NOT NULL THEN CASE WHEN ((held = 'long' AND c > 0) OR (held = 'short' AND c < 0)) AND abs(c) >= 0.15 THEN 'rien' ELSE 'fermer' END WHEN abs(c) >= 0.35 THEN 'ouvrir' ELSE 'rien' END AS action FROM s")
def _(v):
    c = v.votes.groupBy("symbol", "t").agg(F.round(F.sum(F.col("vote") * F.col("confidence")) / F.sum("confidence"), 9).alias("c"))
    day = F.floor(F.col("t") / 86400) % 3
    return c.select("symbol", "t", D.position_action(F.col("c"), F.when(day == 0, "long").when(day == 1, "short")).alias("action"))


@query("f3_stop_and_target", B + " SELECT symbol, t, round(close - CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN rn % 3 = 0 THEN 1.5 * (high - low) ELSE close * 0.015 END, 6) AS stop, round(close + CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN rn % 3 = 0 THEN 1.5 * (high - low) ELSE close * 0.015 END * 1.5, 6) AS target FROM bars WHERE high > low")
def _(v):
    stop, target = D.stop_and_target(F.when(F.col("rn") % 2 == 0, "long").otherwise("short"), F.col("close"), F.when(F.col("rn") % 3 == 0, F.col("high") - F.col("low")))
    return v.bars.where("high > low").select("symbol", "t", F.round(stop, 6).alias("stop"), F.round(target, 6).alias("target"))


@query("f3_carry_actions", E + ", x AS (SELECT event_id, value / 5 - 4 AS apr, CASE WHEN user_id % 3 = 0 THEN value END AS held, CASE WHEN user_id % 2 = 0 THEN 'carry' ELSE 'auto' END AS owner, CASE WHEN user_id % 7 <> 0 THEN value * 0.3 END AS cover FROM ev), y AS (SELECT *, CASE WHEN apr >= 5 THEN 'ATTRACTIF' WHEN apr >= 0 THEN 'NEUTRE' ELSE 'NEGATIF' END AS label, least(15, coalesce(cover, 0) * 0.95) AS target FROM x) SELECT event_id, label, CASE WHEN held IS NOT NULL THEN CASE WHEN owner <> 'carry' THEN 'rien' WHEN apr < 2 THEN 'fermer' WHEN label = 'ATTRACTIF' AND cover IS NOT NULL AND least(target - held, 10) >= 6 THEN 'renforcer' ELSE 'rien' END WHEN label = 'ATTRACTIF' AND cover IS NOT NULL AND least(target, 10) >= 6 THEN 'ouvrir' ELSE 'rien' END AS action FROM y")
def _(v):
    apr, x = F.col("value") / 5 - 4, F.col("user_id")
    df = v.events.select("event_id", apr.alias("apr"), F.when(x % 3 == 0, F.col("value")).alias("held"), F.when(x % 2 == 0, "carry").otherwise("auto").alias("owner"), F.when(x % 7 != 0, F.col("value") * 0.3).alias("cover"))
    df = df.withColumn("label", D.carry_label(F.col("apr")))
    return df.select("event_id", "label", D.carry_action(F.col("apr"), F.col("label"), F.col("held"), F.col("owner"), F.lit("short"), F.col("cover")).alias("action"))


@query("f4_risk_regime", E + ", s AS (SELECT event_id, CASE WHEN value >= 25 THEN -2 WHEN value >= 20 THEN -1 ELSE 1 END + CASE WHEN user_id % 10 - 3 < 0 THEN -1 ELSE 1 END + CASE WHEN (event_id % 30 - 15) / 10.0 > 0.5 THEN -1 WHEN (event_id % 30 - 15) / 10.0 < -0.5 THEN 1 ELSE 0 END AS score FROM ev) SELECT event_id, score, CASE WHEN score > 0 THEN 'RISK_ON' WHEN score < 0 THEN 'RISK_OFF' ELSE 'NEUTRE' END AS regime FROM s")
def _(v):
    r = D.risk_regime(F.col("value"), (F.col("user_id") % 10 - 3).cast("double"), (F.col("event_id") % 30 - 15) / 10.0)
    return v.events.select("event_id", r["score"].alias("score"), r["regime"].alias("regime"))


@query("f4_policy_stance", E + ", x AS (SELECT event_id, 1.5 + (user_id % 20) / 10.0 AS pce, CASE WHEN event_id % 4 <> 0 THEN 3.0 + (event_id % 30) / 10.0 END AS u, CASE WHEN event_id % 5 <> 0 THEN value * 4 END AS n, (user_id % 30) / 10.0 AS r, (event_id % 50 - 25) / 10.0 AS d, value AS vix FROM ev), j AS (SELECT *, CASE WHEN u < 4 THEN 0.6 WHEN u > 5 THEN -0.6 WHEN u IS NOT NULL THEN greatest(-1, least(1, (4.5 - u) / 0.5 * 0.6)) END AS a, CASE WHEN n < 100 THEN -0.6 WHEN n > 250 THEN 0.6 WHEN n IS NOT NULL THEN greatest(-1, least(1, (n - 175) / 75 * 0.6)) END AS b FROM x), k AS (SELECT *, CASE WHEN pce < 2 THEN -1.0 WHEN pce <= 2.5 THEN 0.0 WHEN pce <= 3 THEN 0.6 ELSE 1.0 END AS p1, coalesce((a + b) / 2, a, b) AS p2, CASE WHEN r >= 2 THEN 1.0 WHEN r <= 1 THEN -0.6 ELSE greatest(-1, least(1, (r - 1.5) / 0.5 * 0.8)) END AS p3, CASE WHEN d >= 2 THEN 0.8 WHEN d <= -2 THEN -0.8 ELSE d / 2 * 0.8 END AS p4, CASE WHEN vix >= 25 THEN 0.6 WHEN vix <= 15 THEN -0.4 ELSE (vix - 20) / 5 * 0.6 END AS p5 FROM j) SELECT event_id, round((0.3 * p1 + 0.2 * coalesce(p2, 0) + 0.2 * p3 + 0.2 * p4 + 0.1 * p5) / (0.8 + CASE WHEN p2 IS NULL THEN 0 ELSE 0.2 END), 6) AS stance FROM k")
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    df = v.events.select("event_id", (1.5 + (u % 20) / 10.0).alias("pce"), F.when(e % 4 != 0, 3.0 + (e % 30) / 10.0).alias("unemployment"), F.when(e % 5 != 0, F.col("value") * 4).alias("payrolls"), ((u % 30) / 10.0).alias("real_rate"), ((e % 50 - 25) / 10.0).alias("dollar"), F.col("value").alias("vix"))
    return D.policy_stance(df).select("event_id", F.round("stance", 6).alias("stance"))


@query("f4_nowcast", E + ", x AS (SELECT event_id, (user_id % 20 - 10) / 10.0 AS nfci, (event_id % 9 - 4) / 10.0 AS nc, (user_id % 30 - 10) / 10.0 AS cu, (event_id % 7 - 3) / 10.0 AS cc, value AS vix, 3.0 + (user_id % 50) / 10.0 AS hy, (event_id % 11 - 5) / 5.0 AS hc FROM ev), y AS (SELECT *, greatest(-1, least(1, nfci / 0.6)) AS fin, greatest(-1, least(1, cu)) AS sl, greatest(-1, least(1, (vix - 18) / 17)) AS fe, greatest(-1, least(1, (hy - 3.5) / 4.5)) AS cr, greatest(-1, least(1, nc / 0.3 + hc / 1.5)) AS ti FROM x), z AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, cc / 0.4)) - ti)) AS ea FROM y), s AS (SELECT event_id, fe, cr, fin, round(sl - fin - fe - cr - greatest(0, ti), 9) AS a, round(1.5 * greatest(0, ti) - 0.5 * sl + 0.5 * fe + 0.5 * greatest(0, fin), 9) AS b, round(1.5 * cr + fe + 1.2 * greatest(0, -sl) + greatest(0, fin), 9) AS c, round(1.5 * greatest(0, ea) + greatest(0, cc) / 0.4 - greatest(0, cr - 0.3), 9) AS d FROM z) SELECT event_id, CASE greatest(a, b, c, d) WHEN a THEN 'expansion' WHEN b THEN 'slowdown' WHEN c THEN 'recession' ELSE 'recovery' END AS regime, round(greatest(0, least(1, (list_sort([a, b, c, d])[4] - list_sort([a, b, c, d])[3]) / 2)), 4)::DOUBLE AS confidence, round(greatest(0, least(1, (fe + cr + greatest(0, fin)) / 3)), 6) AS stress FROM s")
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    df = v.events.select("event_id", ((u % 20 - 10) / 10.0).alias("nfci"), ((e % 9 - 4) / 10.0).alias("nfci_chg"), ((u % 30 - 10) / 10.0).alias("curve"), ((e % 7 - 3) / 10.0).alias("curve_chg"), F.col("value").alias("vix"), (3.0 + (u % 50) / 10.0).alias("hy"), ((e % 11 - 5) / 5.0).alias("hy_chg"))
    return D.nowcast(df).select("event_id", "regime", F.round("confidence", 4).alias("confidence"), F.round("stress", 6).alias("stress"))


@query("f5_votes", E + ", x AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (value - 50) / 20 END AS z, (user_id % 20 - 10) / 10000.0 AS f, CASE WHEN event_id % 4 <> 0 THEN 0.2 + (user_id % 30) / 10.0 END AS ls, (event_id % 20 - 10) / 10.0 AS basis FROM ev), y AS (SELECT *, CASE WHEN abs(f) >= 0.0005 THEN greatest(-1, least(1, 1.5 * -greatest(-1, least(1, z / 2.5)))) ELSE -greatest(-1, least(1, z / 2.5)) END AS cf, CASE WHEN ls >= 1 THEN least(1, (ls - 1) / 1.5) WHEN ls > 0 THEN -least(1, (1 / ls - 1) / 1.5) END AS crowd, -greatest(-1, least(1, basis / 0.5)) * 0.4 AS cb FROM x) SELECT event_id, round(CASE WHEN z IS NULL AND crowd IS NULL THEN 0 ELSE greatest(-1, least(1, (CASE WHEN z IS NULL THEN 0 ELSE 0.5 * cf END + coalesce(0.35 * -crowd * 0.8, 0) + 0.15 * cb) / (CASE WHEN z IS NULL THEN 0 ELSE 0.5 END + CASE WHEN crowd IS NULL THEN 0 ELSE 0.35 END + 0.15))) END, 6) AS carry_vote, round(0.6 * tanh(z / 0.5) + 0.4 * tanh(basis / 2), 6) AS flow_both FROM y")
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    z, ls, basis = F.when(e % 3 != 0, (F.col("value") - 50) / 20), F.when(e % 4 != 0, 0.2 + (u % 30) / 10.0), (e % 20 - 10) / 10.0
    crowd = F.when(ls.isNotNull(), S.crowd(ls))
    zz = z
    c = D.carry_vote(zz, (u % 20 - 10) / 10000.0, crowd, basis)
    return v.events.select("event_id", F.round(c["vote"], 6).alias("carry_vote"), F.round(F.when(z.isNotNull(), D.flow_vote(z, basis)), 6).alias("flow_both"))


@query("f6_confluence", E + ", x AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS d, (value - 50) / 100 AS i, event_id % 5 - 2 AS cvd, event_id % 7 - 3 AS b, user_id % 3 AS r FROM ev), s AS (SELECT event_id, (CASE WHEN i > 0.05 THEN 1 WHEN i < -0.05 THEN -1 ELSE 0 END + sign(cvd) + sign(b) + CASE r WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::INT * d AS score FROM x) SELECT event_id, score, CASE WHEN score >= 3 THEN 'FORTE CONFLUENCE' WHEN score >= 1 THEN 'ALIGNÉ' WHEN score = 0 THEN 'MIXTE' WHEN score >= -2 THEN 'DIVERGENT' ELSE 'CONTRE-SIGNAL' END AS label FROM s")
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    r = D.confluence(F.when(u % 2 == 0, 1).otherwise(-1), (F.col("value") - 50) / 100, e % 5 - 2, e % 7 - 3, F.when(u % 3 == 0, "RISK_ON").when(u % 3 == 1, "RISK_OFF"))
    return v.events.select("event_id", r["score"].alias("score"), r["label"].alias("label"))


@query("f7_market_state", B + f", x AS (SELECT symbol, t, rn, (CASE WHEN high <= low THEN 0 ELSE (2 * close - low - high) / (high - low) END) AS clv, volume FROM bars), n AS (SELECT symbol, t, rn, sum(clv * volume) OVER {frame(4)} / sum(volume) OVER {frame(4)} AS a, sum(clv * volume) OVER {frame(19)} / sum(volume) OVER {frame(19)} AS b, sum(clv * volume) OVER {frame(59)} / sum(volume) OVER {frame(59)} AS c FROM x) SELECT symbol, t, (1 + (round(a, 9) > 0)::INT + 2 * (round(b, 9) > 0)::INT + 4 * (round(c, 9) > 0)::INT) AS state FROM n WHERE rn >= 60")
def _(v):
    df = v.bars
    for n, k in (("a", 5), ("b", 20), ("c", 60)):
        df = W.money_flow(df, k).withColumnRenamed("ned", n)
    up = lambda n: (F.round(n, 9) > 0).cast("int")
    return df.where("rn >= 60").select("symbol", "t", (1 + up("a") + 2 * up("b") + 4 * up("c")).alias("state"))


@query("f8_human", "WITH " + VENUES + " SELECT exchange, printf('%.1fM', oi_usd / 1000000) AS m, CASE WHEN oi_usd < 1000 THEN printf('%.1f', oi_usd) WHEN oi_usd < 1000000 THEN printf('%.1fK', oi_usd / 1000) WHEN oi_usd < 1000000000 THEN printf('%.1fM', oi_usd / 1000000) WHEN oi_usd < 1000000000000 THEN printf('%.1fB', oi_usd / 1000000000) ELSE printf('%.1fT', oi_usd / 1000000000000) END AS human FROM venues")
def _(v):
    return v.venues.select("exchange", F.format_string("%.1fM", F.col("oi_usd") / 1e6).alias("m"), S.human(F.col("oi_usd")).alias("human"))


@query("f9_jaccard", E + ", s AS (SELECT event_id, ['a' || (user_id % 5), 'b' || (event_id % 3), 'c'] AS x, ['a' || (event_id % 5), 'b' || (event_id % 3), 'd'] AS y FROM ev) SELECT event_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM s")
def _(v):
    t = lambda k, n: F.concat(F.lit(k), n.cast("string"))
    x = F.array(t("a", F.col("user_id") % 5), t("b", F.col("event_id") % 3), F.lit("c"))
    y = F.array(t("a", F.col("event_id") % 5), t("b", F.col("event_id") % 3), F.lit("d"))
    return v.events.select("event_id", F.round(S.jaccard(x, y), 6).alias("jaccard"))


@query("f9_vote_vectors", "WITH " + VOTES + " SELECT symbol, t, " + ", ".join(f"coalesce(max(vote) FILTER (WHERE agent = '{a}'), 0.0) AS {a}" for a in ("click", "error", "purchase", "signup", "view")) + " FROM votes GROUP BY 1, 2")
def _(v):
    return v.votes.groupBy("symbol", "t").pivot("agent", ["click", "error", "purchase", "signup", "view"]).agg(F.max("vote")).na.fill(0.0)


@query("f10_json_props", E + " SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM ev")
def _(v):
    return v.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f11_version_marks", "WITH " + VOTES + """, l AS (SELECT symbol, arg_max(agent, (t, agent)) AS agent, arg_max((vote * 1000000)::BIGINT, (t, agent)) AS vote FROM votes GROUP BY 1)
SELECT symbol, substr(md5('{"agent":"' || agent || '","millionths":' || vote || '}'), 1, 12) AS mark FROM l""")
def _(v):
    return v.votes.groupBy("symbol").agg(F.max_by(F.struct("agent", "vote"), F.struct("t", "agent")).alias("s")).select("symbol", S.json_mark(F.col("s.agent"), F.round(F.col("s.vote") * 1_000_000).cast("bigint").alias("millionths")).alias("mark"))


RANKED = R + f", f AS {ema_sql(9, 'close').format(name='f')}, s AS {ema_sql(21, 'close').format(name='s')}, " + RSI + ", " + TR + f""", w AS (SELECT *, min(low) OVER {frame(9)} AS lo, max(high) OVER {frame(9)} AS hi FROM bars), x AS (SELECT b.*, f.ema AS f, s.ema AS s, rsi, atr FROM w b JOIN f USING (symbol, rn) JOIN s USING (symbol, rn) JOIN rsi USING (symbol, rn) JOIN aw USING (symbol, rn)),
sc AS (SELECT *, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END + CASE WHEN (f - s) / s * 100 > 0.05 THEN 1 WHEN (f - s) / s * 100 < -0.05 THEN -1 ELSE 0 END + CASE WHEN rsi >= 55 AND rsi < 70 THEN 1 WHEN rsi > 30 AND rsi <= 45 THEN -1 WHEN rsi >= 70 THEN -1 WHEN rsi <= 30 THEN 1 ELSE 0 END AS score FROM x),
de AS (SELECT *, CASE WHEN score >= 3 THEN 'LONG POSSIBLE' WHEN score <= -3 THEN 'SHORT POSSIBLE' WHEN score = 2 THEN 'BIAIS LONG' WHEN score = -2 THEN 'BIAIS SHORT' ELSE 'NEUTRE' END AS decision FROM sc),
st AS (SELECT *, CASE WHEN score >= 2 THEN least(lo, close - 1.5 * atr) WHEN score <= -2 THEN greatest(hi, close + 1.5 * atr) END AS stop_loss FROM de),
ri AS (SELECT *, CASE WHEN score >= 2 AND close > stop_loss THEN close - stop_loss WHEN score <= -2 AND stop_loss > close THEN stop_loss - close END AS risk FROM st),
pl AS (SELECT *, CASE WHEN risk IS NOT NULL THEN CASE WHEN score >= 2 THEN 'LONG' ELSE 'SHORT' END END AS side, CASE WHEN score >= 2 THEN close + 2 * risk ELSE close - 2 * risk END AS take_profit, 0.01 * close / risk AS lev FROM ri)
SELECT symbol, t, score, decision, side, round(CASE WHEN risk IS NOT NULL THEN stop_loss END, 6) AS stop_loss, round(CASE WHEN risk IS NOT NULL THEN take_profit END, 6) AS take_profit, round(lev, 6) AS implied_leverage, CASE WHEN risk IS NULL THEN NULL WHEN lev <= 2 THEN 'ACCEPTÉ' ELSE 'REFUSÉ' END AS status,
CASE WHEN risk IS NULL THEN -999 ELSE score + CASE WHEN lev <= 2 THEN 2 ELSE -2 END + CASE WHEN rsi BETWEEN 55 AND 65 THEN 1 ELSE 0 END - CASE WHEN atr / close * 100 > 1 THEN 1 ELSE 0 END END AS ranking FROM pl"""


@query("plan_ranked_signals", RANKED)
def _(v):
    """The scan end to end: bars, averages, strength, range, score, decision, plan and rank of every bar."""
    df = P.indicators(v.bars).where("rn >= 21 and ema_slow is not null and rsi is not null and atr is not null")
    lo, hi = F.min("low").over(W.last(10)), F.max("high").over(W.last(10))
    base = v.bars.withColumn("lo", lo).withColumn("hi", hi).select("symbol", "t", "lo", "hi")
    df = df.join(base, ["symbol", "t"]).withColumn("score", D.scan_score(F.col("ema_fast"), F.col("ema_slow"), F.col("rsi")))
    df = df.withColumn("decision", D.scan_decision(F.col("score")))
    df = df.withColumns(D.trade_plan(F.col("decision"), F.col("close"), F.col("atr"), F.col("lo"), F.col("hi")))
    rank = D.plan_rank(F.col("score"), F.col("status"), F.col("rsi"), F.col("atr") / F.col("close") * 100)
    return df.select("symbol", "t", "score", "decision", "side", F.round("stop_loss", 6).alias("stop_loss"), F.round("take_profit", 6).alias("take_profit"), F.round("implied_leverage", 6).alias("implied_leverage"), "status", rank.alias("ranking"))
