"""Parsers and sinks, fed with payloads that are made of the carrier views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import side_of
from ..operators import microstructure as M
from ..sources import files, parsers
from .q_windows import B
from .registry import query
from .views import BOOK, EV, FILLS, TAPE, VENUES

E = "WITH " + EV


def text(c):
    return F.col(c).cast("string")


@query("s2_accepted_rows", E + " SELECT event_id FROM ev WHERE user_id % 3 <> 0")
def _(v):
    return files.accepted(v.journal).select("event_id")


@query("s6_tail_of_journal", E + " SELECT event_id, event_type FROM ev ORDER BY event_id DESC LIMIT 100")
def _(v):
    return files.tail(v.events.select("event_id", "event_type"), 100, F.col("event_id"))


@query("s6_bad_lines_dropped", E + " SELECT event_id, round(value, 6) AS value FROM ev WHERE event_id % 50 <> 0")
def _(v):
    lines = v.events.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "value"))).alias("line"))
    r = lines.select(F.from_json("line", "event_id bigint, value double").alias("r")).where("r.event_id is not null")
    return r.select("r.event_id", F.round("r.value", 6).alias("value"))


@query("s8_backfill", E + " SELECT event_id, value FROM ev WHERE event_id % 4 = 0")
def _(v):
    have = v.events.where("event_id % 4 <> 0").select("event_id", "value")
    pages = v.events.select("event_id", "value")
    return files.backfill(have, pages.unionByName(pages.where("event_id % 3 = 0")), ["event_id"])


@query("s9_candle_payloads", B + " SELECT symbol, t, open, high, low, close, volume FROM bars WHERE rn % 10 <> 0")
def _(v):
    """Rows of text arrays, milliseconds, with broken rows among them."""
    bad = F.col("rn") % 10 == 0
    row = F.array((F.col("t") * 1000).cast("string"), text("open"), text("high"), F.when(bad, "x").otherwise(text("low")), text("close"), text("volume"), F.lit("q"))
    payload = v.bars.groupBy("symbol").agg(F.to_json(F.collect_list(row)).alias("payload"))  # as many as one reply holds
    return parsers.candles(payload).select("symbol", "t", "open", "high", "low", "close", "volume")


@query("s10_fallback_chain", E + ", a AS (SELECT event_type, event_id, value FROM ev WHERE event_id % 3 = 0), n AS (SELECT event_type, count(*) AS n FROM a WHERE event_type <> 'error' GROUP BY 1) SELECT event_type, event_id, 0 AS source FROM a WHERE event_type IN (SELECT event_type FROM n) UNION ALL SELECT event_type, event_id, 1 FROM ev WHERE event_id % 5 = 0 AND event_type NOT IN (SELECT event_type FROM n)")
def _(v):
    first = v.events.where("event_id % 3 = 0 and event_type <> 'error'").select("event_type", "event_id")
    second = v.events.where("event_id % 5 = 0").select("event_type", "event_id")
    return files.first_source([(first, 10), (second, 1)], ["event_type"])


@query("s11_book_payloads", "WITH " + BOOK + " SELECT snap, side, price, size FROM book")
def _(v):
    level = F.array(text("price"), text("size"))
    bid = F.col("side") == "bid"
    p = v.book.groupBy("snap").agg(F.to_json(F.struct(F.collect_list(F.when(bid, level)).alias("bids"), F.collect_list(F.when(~bid, level)).alias("asks"))).alias("payload"))
    return parsers.order_book(p).select("snap", "side", "price", "size")


@query("s11_trade_payloads", "WITH " + TAPE + " SELECT symbol, t, price, size, side FROM tape")
def _(v):
    """A payload for each symbol and hour, as venues page them; two symbols come as objects, the others as arrays."""
    s = v.tape
    page = ["symbol", F.floor(F.col("t") / 3600).alias("hour")]
    obj = F.struct(text("t").alias("ts"), text("price").alias("price"), text("size").alias("size"), F.upper("side").alias("side"))
    arr = F.array(text("t"), text("price"), text("size"), F.col("side"))
    objects = F.col("symbol").isin("click", "view")
    p = s.where(objects).groupBy(*page).agg(F.to_json(F.collect_list(obj)).alias("payload"))
    p = p.unionByName(s.where(~objects).groupBy(*page).agg(F.to_json(F.collect_list(arr)).alias("payload"))).drop("hour")
    return parsers.trades(p).select("symbol", "t", "price", "size", "side")


@query("s12_feed_messages", E + " SELECT event_id, event_type AS channel, 'S' || (user_id % 8) AS symbol FROM ev WHERE event_id % 10 >= 3")
def _(v):
    k = F.col("event_id") % 10
    good = F.to_json(F.struct(F.struct(F.col("event_type").alias("channel"), F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("instId")).alias("arg"), F.array(F.struct("value")).alias("data")))
    ack = F.lit('{"event":"subscribe","arg":{"channel":"books","instId":"X"}}')
    df = v.events.select("event_id", F.when(k == 0, "pong").when(k == 1, ack).when(k == 2, "{bad").otherwise(good).alias("payload"))
    return parsers.messages(df).select("event_id", "channel", "symbol")


@query("s13_series_csv", "SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 HAVING day(o_orderdate::DATE) <> 13")
def _(v):
    s = v.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    lines = s.select(F.concat_ws(",", text("d"), F.when(F.day("d") == 13, ".").otherwise(text("x"))).alias("line"))
    return parsers.series_csv(lines.unionByName(v.spark.createDataFrame([("DATE,VALUE",), ("2020-01-01,",)], "line string")))


@query("s14_page_titles", r"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<a [^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '')[1:5], '|') AS titles FROM pages")
def _(v):
    """Links of raw pages as feed titles: the first is the page's own and is dropped."""
    feed = F.regexp_replace("html", r"(?is)<a [^>]*>(.*?)</a>", "<title><![CDATA[$1]]></title>")
    return parsers.rss_titles(v.table("pages").select("page_id", feed.alias("payload")), most=5).select("page_id", F.array_join("titles", "|").alias("titles"))


@query("s16_supply_series", "WITH s AS (SELECT n_regionkey AS r, (n_nationkey * 86400)::BIGINT AS t, (n_nationkey * 3.5 + 1)::DOUBLE AS value, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS k FROM nation) SELECT r, t, value FROM s WHERE k > 1")
def _(v):
    k = F.col("n_nationkey")
    value = (k * 3.5 + 1).cast("string")
    shape = F.when(k % 2 == 0, F.concat(F.lit('{"peggedUSD":'), value, F.lit("}"))).otherwise(value)
    one = F.concat(F.lit('{"date":"'), (k * 86400).cast("string"), F.lit('","totalCirculating":'), shape, F.lit("}"))
    p = v.table("nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, one.alias("j")))), lambda s: s["j"]), ","), F.lit("]")).alias("payload"))
    return parsers.supply(p).select("r", "t", "value")


@query("s19_prediction_markets", "SELECT p_name || ' ' || p_partkey AS question, round(p_retailprice, 2) AS volume, (p_partkey % 100) / 100.0::DOUBLE AS yes FROM part ORDER BY volume DESC, question LIMIT 10")
def _(v):
    k = F.col("p_partkey")
    x = F.struct(F.concat_ws(" ", "p_name", k.cast("string")).alias("question"), F.round("p_retailprice", 2).cast("string").alias("volume"), F.lit('["Yes","No"]').alias("outcomes"), F.concat(F.lit('["'), ((k % 100) / 100.0).cast("string"), F.lit('","0"]')).alias("outcomePrices"))
    return parsers.markets(v.table("part").select(F.to_json(F.array(x)).alias("payload")))


@query("s20_calendar", E + ", x AS (SELECT event_id, sec, CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank, (sec - 1705276800) / 3600.0::DOUBLE AS h FROM ev WHERE event_type IN ('click', 'view')) SELECT event_id, rank, round(h, 6) AS hours_until FROM x WHERE rank >= 2 AND h BETWEEN 0 AND 24")
def _(v):
    u = F.col("user_id") % 3
    df = v.events.select("event_id", F.col("sec").alias("t"), F.when(u == 0, "High").when(u == 1, "Medium").otherwise("Low").alias("impact"), F.col("event_type").alias("country"), text("event_id").alias("title"))
    return parsers.calendar(df, 1_705_276_800, 24, ["click", "view"], 2).select("event_id", "rank", F.round("hours_until", 6).alias("hours_until"))


@query("s21_token_risk", "WITH x AS (SELECT p_partkey, p_partkey % 11 = 0 AS honey, p_partkey % 5 = 0 AS mint, p_partkey % 3 = 0 AS proxy, (p_size % 20) / 100.0::DOUBLE AS tax FROM part) SELECT p_partkey, tax, CASE WHEN honey OR tax >= 0.5 THEN 'CRITIQUE' WHEN mint::INT + proxy::INT >= 2 OR tax >= 0.1 THEN 'ÉLEVÉ' WHEN mint OR proxy THEN 'MOYEN' ELSE 'FAIBLE' END AS tier FROM x")
def _(v):
    k = F.col("p_partkey")
    flag = lambda n: F.when(k % n == 0, "1").otherwise("0")
    p = F.to_json(F.struct(flag(11).alias("is_honeypot"), flag(5).alias("is_mintable"), flag(3).alias("is_proxy"), ((F.col("p_size") % 20) / 100.0).cast("string").alias("buy_tax"), F.lit("x").alias("sell_tax")))
    return parsers.risk_flags(v.table("part").select("p_partkey", p.alias("payload"))).select("p_partkey", "tax", "tier")


@query("s22_quote_changes", B + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM bars) SELECT symbol AS name, round(max(close) FILTER (WHERE k = 1), 6) AS last, round((max(close) FILTER (WHERE k = 1) - max(close) FILTER (WHERE k = 2)) / max(close) FILTER (WHERE k = 2) * 100 * CASE WHEN symbol = 'view' THEN -1 ELSE 1 END, 6) AS change_pct FROM k GROUP BY symbol")
def _(v):
    two = v.bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))).where("k <= 2")
    df = two.select(F.col("symbol").alias("name"), "t", F.col("close").alias("value"), (F.col("symbol") == "view").alias("inverted"))
    return parsers.quote_changes(df).select("name", F.round("last", 6).alias("last"), F.round("change_pct", 6).alias("change_pct"))


@query("s23_tickers", "SELECT upper(split_part(p_name, ' ', 1)) || p_partkey || 'USDT' AS symbol, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_size::DOUBLE END AS volume FROM part WHERE p_partkey % 3 <> 0")
def _(v):
    k = F.col("p_partkey")
    name = F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), k.cast("string"), F.when(k % 3 != 0, "usdt").otherwise("eur"))
    x = F.struct(name.alias("symbol"), F.round("p_retailprice", 2).cast("string").alias("lastPr"), F.when(k % 4 != 0, text("p_size")).alias("usdtVolume"))
    return parsers.tickers(v.table("part").select(F.to_json(F.array(x)).alias("payload")))


@query("s24_notes", "SELECT doc_id, 'd' || doc_id AS id, lang AS category, source AS target FROM documents")
def _(v):
    body = F.concat(F.lit("---\nid: d"), text("doc_id"), F.lit("\ncategory: "), F.col("lang"), F.lit("\ntarget:  "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    return parsers.notes(v.table("documents").select("doc_id", body.alias("text"))).select("doc_id", "id", "category", "target")


@query("s25_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "events", "documents")))
def _(v):
    out = None
    for t in ("orders", "events", "documents"):
        one = v.table(t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("d21_fee_details", "WITH " + FILLS + " SELECT order_id, line, fee_coin, round(sum(fee), 6) AS fee, count(*) AS n FROM fills GROUP BY 1, 2, 3")
def _(v):
    one = F.struct(F.lower("fee_coin").alias("feeCoin"), (-F.col("fee")).cast("string").alias("totalFee"))
    shape = F.when(F.col("line") % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.array(one)))
    df = parsers.fee_details(v.fills.select("order_id", "line", shape.alias("fee_detail")))
    return df.groupBy("order_id", "line", "fee_coin").agg(F.round(F.sum("fee"), 6).alias("fee"), F.count("*").alias("n"))


@query("x1_top_of_book", "WITH " + BOOK + ", k AS (SELECT *, row_number() OVER (PARTITION BY snap, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS k FROM book), g AS (SELECT snap, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask, coalesce(sum(size) FILTER (WHERE side = 'bid'), 0) AS qb, coalesce(sum(size) FILTER (WHERE side = 'ask'), 0) AS qa FROM k WHERE k <= 5 GROUP BY 1) SELECT snap, round(CASE WHEN bid IS NULL OR ask IS NULL THEN 0 ELSE (bid + ask) / 2 END, 6) AS mid, round(CASE WHEN bid IS NULL OR ask IS NULL THEN 0 ELSE (ask - bid) / ((bid + ask) / 2) * 10000 END, 4) AS spread_bps, round((qb - qa) / (qb + qa), 6) AS queue_imbalance FROM g")
def _(v):
    return M.top_of_book(v.book).select("snap", F.round("mid", 6).alias("mid"), F.round("spread_bps", 4).alias("spread_bps"), F.round("queue_imbalance", 6).alias("queue_imbalance"))


@query("x1_trade_sign", "WITH " + TAPE + " SELECT symbol, round((sum(size) FILTER (WHERE side = 'buy') - sum(size) FILTER (WHERE side = 'sell')) / sum(size), 6) AS trade_sign FROM tape GROUP BY 1")
def _(v):
    s = F.when(F.col("side").startswith("b"), F.col("size")).otherwise(-F.col("size"))
    return v.tape.groupBy("symbol").agg(F.round(F.sum(s) / F.sum("size"), 6).alias("trade_sign"))


@query("x4_naive_liquidation", "WITH " + VENUES + " SELECT exchange, lev AS leverage, round(mark * (1 - (1.0 / lev - 0.005)), 4) AS long_price, round(mark * (1 + (1.0 / lev - 0.005)), 4) AS short_price FROM venues, (VALUES (5), (10), (25), (50), (100)) l(lev)")
def _(v):
    df = v.venues.withColumn("leverage", F.explode(F.array(*[F.lit(x) for x in (5, 10, 25, 50, 100)])))
    move = 1.0 / F.col("leverage") - 0.005
    return df.select("exchange", "leverage", F.round(F.col("mark") * (1 - move), 4).alias("long_price"), F.round(F.col("mark") * (1 + move), 4).alias("short_price"))


@query("x5_sharpe", B + ", r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM bars) SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(1460), 6) AS sharpe FROM r GROUP BY 1")
def _(v):
    from ..operators import windows as W

    r = v.bars.select("symbol", (F.try_divide("close", W.lag("close")) - 1).alias("r"))
    return r.groupBy("symbol").agg(F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(1460.0)), 6).alias("sharpe"))


@query("x7_size_adjustment", E + ", x AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS d, (value - 50) / 50 AS c FROM ev) SELECT event_id, round(CASE WHEN abs(c) > 0.2 AND sign(c) <> d AND abs(c) >= 0.3 THEN 0.0 WHEN abs(c) > 0.2 AND sign(c) = d THEN least(1.0, 0.4 + 0.6 * abs(c)) ELSE 0.6 END, 6) AS factor FROM x")
def _(v):
    c = (F.col("value") - 50) / 50
    d = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    lean, same = F.abs(c) > 0.2, F.signum(c) == d
    return v.events.select("event_id", F.round(F.when(lean & ~same & (F.abs(c) >= 0.3), 0.0).when(lean & same, F.least(F.lit(1.0), 0.4 + 0.6 * F.abs(c))).otherwise(0.6), 6).alias("factor"))


@query("x8_approval_states", E + " SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'REJECTED' WHEN value > 80 THEN 'REJECTED' WHEN user_id % 5 = 1 THEN 'APPROVED_SIMULATION' ELSE 'PENDING_APPROVAL' END AS status FROM ev")
def _(v):
    u = F.col("user_id") % 5
    return v.events.select("event_id", F.when((u == 0) | (F.col("value") > 80), "REJECTED").when(u == 1, "APPROVED_SIMULATION").otherwise("PENDING_APPROVAL").alias("status"))


@query("x11_near_liquidation", "WITH " + VENUES + " SELECT exchange, n_name, round(abs(mark - liq) / mark * 100, 4) AS gap_pct FROM (SELECT exchange, mark, n_name, mark * (0.7 + (n_nationkey % 30) / 100.0) AS liq FROM venues, nation) WHERE abs(mark - liq) / mark * 100 < 15")
def _(v):
    n = v.table("nation").select("n_name", (0.7 + (F.col("n_nationkey") % 30) / 100.0).alias("k"))
    df = v.venues.crossJoin(F.broadcast(n))  # nations, a fixed table
    gap = F.abs(F.col("mark") - F.col("mark") * F.col("k")) / F.col("mark") * 100
    return df.where(gap < 15).select("exchange", "n_name", F.round(gap, 4).alias("gap_pct"))


@query("x12_runway", E + ", d AS (SELECT sec // 86400 AS day, sum(value) AS s FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT round(100000 / avg(s), 4) AS days, count(*) AS n FROM d")
def _(v):
    d = v.events.where("event_type = 'purchase'").groupBy(F.floor(F.col("sec") / 86400).alias("day")).agg(F.sum("value").alias("s"))
    return d.agg(F.round(100000 / F.avg("s"), 4).alias("days"), F.count("*").alias("n"))


@query("x13_positions_by_side", "WITH " + TAPE + " SELECT symbol, round(sum(size) FILTER (WHERE side = 'buy'), 4) AS long_size, round(sum(size * price) FILTER (WHERE side = 'buy'), 4) AS long_notional, round(sum(size) FILTER (WHERE side = 'sell'), 4) AS short_size, round(sum(size * price) FILTER (WHERE side = 'sell'), 4) AS short_notional FROM tape GROUP BY 1")
def _(v):
    buy = side_of(F.col("side")) == "LONG"
    amount = F.col("size") * F.col("price")
    agg = lambda c, on, n: F.round(F.sum(F.when(on, c)), 4).alias(n)
    return v.tape.groupBy("symbol").agg(agg(F.col("size"), buy, "long_size"), agg(amount, buy, "long_notional"), agg(F.col("size"), ~buy, "short_size"), agg(amount, ~buy, "short_notional"))


@query("x15_feature_edges", "WITH " + TAPE + ", h AS (SELECT symbol, (t // 3600) * 3600 AS t, avg(price) AS mid, sum(CASE side WHEN 'buy' THEN size ELSE -size END) AS ofi, avg(size) AS depth FROM tape GROUP BY 1, 2), f AS (SELECT *, lead(mid, 5) OVER (PARTITION BY symbol ORDER BY t) / mid - 1 AS fwd FROM h), u AS (SELECT 'ofi' AS feature, round(ofi, 9) AS x, round(fwd, 12) AS fwd FROM f WHERE fwd IS NOT NULL UNION ALL SELECT 'depth', round(depth, 9), round(fwd, 12) FROM f WHERE fwd IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, fwd) - 1) / 2.0 AS rb FROM u) SELECT feature, count(*) AS n, round(corr(ra, rb), 6) AS ic FROM k GROUP BY 1")
def _(v):
    from ..operators import quant as Q

    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    h = v.tape.groupBy("symbol", (F.floor(F.col("t") / 3600) * 3600).alias("t")).agg(F.avg("price").alias("mid"), F.sum(signed).alias("ofi"), F.avg("size").alias("depth"))
    f = h.withColumn("fwd", F.round(F.lead("mid", 5).over(Window.partitionBy("symbol").orderBy("t")) / F.col("mid") - 1, 12)).where("fwd is not null")
    u = f.select(F.expr("stack(2, 'ofi', round(ofi, 9), 'depth', round(depth, 9)) as (feature, x)"), "fwd")
    return Q.rank_ic(u, ["feature"], "x", "fwd").select("feature", "n", F.round("ic", 6).alias("ic"))


@query("x24_arbitrage", "WITH " + VENUES + ", m AS (SELECT a.exchange, a.mark, median(b.mark) AS fair FROM venues a JOIN venues b ON a.exchange <> b.exchange GROUP BY 1, 2), w AS (SELECT sum(mark * oi_usd) / sum(oi_usd) AS wm FROM venues) SELECT exchange, round(fair, 4) AS fair, round((mark - fair) / fair * 100, 6) AS premium_pct, (mark - fair) / fair * 100 <= 0.1 AS fair_to_buy, round(wm, 4) AS weighted_mark FROM m, w")
def _(v):
    a, b = v.venues.alias("a"), v.venues.alias("b")  # a row for each venue
    m = a.join(b, F.col("a.exchange") != F.col("b.exchange")).groupBy(F.col("a.exchange").alias("exchange"), F.col("a.mark").alias("mark")).agg(F.percentile("b.mark", 0.5).alias("fair"))
    w = v.venues.agg((F.sum(F.col("mark") * F.col("oi_usd")) / F.sum("oi_usd")).alias("wm"))
    prem = (F.col("mark") - F.col("fair")) / F.col("fair") * 100
    return m.crossJoin(F.broadcast(w)).select("exchange", F.round("fair", 4).alias("fair"), F.round(prem, 6).alias("premium_pct"), (prem <= 0.1).alias("fair_to_buy"), F.round("wm", 4).alias("weighted_mark"))


@query("r4_minute_history", "WITH " + TAPE + ", s AS (SELECT symbol, t, avg(price) AS mid, sum(CASE side WHEN 'buy' THEN size ELSE -size END) AS ofi FROM tape GROUP BY 1, 2) SELECT symbol, (t // 3600) * 3600 AS t, round(arg_max(mid, t), 4) AS mid, round(avg(ofi), 9) AS ofi, count(*) AS n FROM s GROUP BY 1, (s.t // 3600) * 3600")
def _(v):
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    s = v.tape.groupBy("symbol", "t").agg(F.avg("price").alias("mid"), F.sum(signed).alias("ofi")).withColumn("queue_imbalance", F.lit(0.0)).withColumn("trade_sign", F.lit(0.0)).withColumn("spread_bps", F.lit(0.0))
    return M.minute_history(s, 3600).select("symbol", "t", F.round("mid", 4).alias("mid"), F.round("ofi", 9).alias("ofi"), "n")
