"""Parsers of exchange, macro and market payloads: text columns in, typed rows out. Bad rows are dropped, never raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """[[ts, open, high, low, close, volume, ...], ...] -> t (seconds), open, high, low, close, volume beside df's other columns."""
    rest = [c for c in df.columns if c != payload]
    r = F.col("r")
    t = F.get(r, F.lit(0)).try_cast("double")
    out = df.select(*rest, F.explode(F.from_json(payload, "array<array<string>>")).alias("r")).select(
        *rest, F.when(t > 1e11, t / 1000).otherwise(t).cast("bigint").alias("t"), *[F.get(r, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)])
    return out.where("t is not null and open is not null and high is not null and low is not null and close is not null and volume is not null")


BOOK = "struct<bids:array<array<string>>,asks:array<array<string>>>"


def order_book(df: DataFrame, payload: str = "payload") -> DataFrame:
    """{"bids": [[price, size], ...], "asks": ...} -> side, price, size."""
    rest = [c for c in df.columns if c != payload]
    b = df.withColumn("b", F.from_json(payload, BOOK))
    none = F.array().cast("array<array<string>>")

    def levels(name: str, side: str) -> Column:
        return F.transform(F.coalesce(F.col(f"b.{name}"), none), lambda x: F.struct(F.lit(side).alias("side"), F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("size")))

    sides = F.concat(levels("bids", "bid"), levels("asks", "ask"))
    return b.select(*rest, F.explode(sides).alias("l")).select(*rest, "l.*").where("price is not null and size is not null")


def trades(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Objects {price, size, side, ts} or arrays [ts, price, size, side] -> t, price, size, side."""
    rest = [c for c in df.columns if c != payload]
    arrays = F.from_json(payload, "array<array<string>>")
    objects = F.from_json(payload, "array<struct<ts:string,price:string,size:string,side:string>>")
    made = F.when(F.col(payload).rlike(r"^\s*\[\s*\["), F.transform(arrays, lambda x: F.struct(F.get(x, 0).alias("ts"), F.get(x, 1).alias("price"), F.get(x, 2).alias("size"), F.get(x, 3).alias("side")))).otherwise(objects)
    return df.select(*rest, F.explode(made).alias("x")).select(*rest, F.expr("try_cast(x.ts as bigint)").alias("t"), F.expr("try_cast(x.price as double)").alias("price"), F.expr("try_cast(x.size as double)").alias("size"), F.lower("x.side").alias("side")).where("price is not null and size is not null")


def messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Feed messages by channel and instrument; pongs, acknowledgements and what isn't JSON are dropped."""
    m = F.from_json(payload, "struct<event:string,arg:struct<channel:string,instId:string>,data:string>")
    return df.withColumn("m", m).where(F.col("m.arg.channel").isNotNull() & F.col("m.event").isNull() & F.col("m.data").isNotNull()).select(*[c for c in df.columns if c != payload], F.col("m.arg.channel").alias("channel"), F.col("m.arg.instId").alias("symbol"), F.col("m.data").alias("data"))


def series_csv(df: DataFrame, line: str = "line") -> DataFrame:
    """date,value lines -> day, value; the header, '.' and blanks are dropped."""
    parts = F.split(line, ",")
    return df.select(*[c for c in df.columns if c != line], F.expr(f"try_cast(split({line}, ',')[0] as date)").alias("day"), number(F.get(parts, F.lit(1))).alias("value")).where("day is not null and value is not null and not isnan(value)")


def rss_titles(df: DataFrame, payload: str = "payload", most: int = 10) -> DataFrame:
    """Titles of a feed without the channel's own, tags and CDATA taken off; a row for each text."""
    raw = F.regexp_extract_all(payload, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1))
    clean = F.transform(raw, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", ""), r"\s+", " ")))
    return df.select(*[c for c in df.columns if c != payload], F.slice(F.filter(clean, lambda t: t != ""), 2, most).alias("titles"))


def fee_details(df: DataFrame, name: str = "fee_detail") -> DataFrame:
    """feeDetail as an array, an object or JSON text of either -> fee_coin, fee (absolute); rows without stay, with nulls."""
    one = "struct<feeCoin:string,totalFee:string>"
    text = F.col(name)
    many = F.when(text.startswith("["), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(many).alias("f")).select(*[c for c in df.columns if c != name], F.upper("f.feeCoin").alias("fee_coin"), F.abs(F.expr("try_cast(f.totalFee as double)")).alias("fee"))


def supply(df: DataFrame, payload: str = "payload") -> DataFrame:
    """[{date, totalCirculating: number or {peggedUSD}}] -> t, value; the last point, still partial, is dropped."""
    rest = [c for c in df.columns if c != payload]
    rows = F.from_json(payload, "array<struct<date:string,totalCirculating:string>>")
    value = F.coalesce(F.get_json_object("x.totalCirculating", "$.peggedUSD"), F.col("x.totalCirculating")).try_cast("double")
    out = df.select(*rest, F.posexplode(rows).alias("pos", "x"), F.size(rows).alias("n")).where("pos < n - 1")
    return out.select(*rest, F.expr("try_cast(x.date as bigint)").alias("t"), value.alias("value")).where("t is not null and value >= 0")


def tickers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """[{symbol, lastPr, usdtVolume}] -> symbol, price, volume of USDT pairs; volume 0 where there is none."""
    rows = F.from_json(payload, "array<struct<symbol:string,lastPr:string,usdtVolume:string>>")
    return df.select(F.explode(rows).alias("x")).select(F.upper("x.symbol").alias("symbol"), F.expr("try_cast(x.lastPr as double)").alias("price"), F.coalesce(F.expr("try_cast(x.usdtVolume as double)"), F.lit(0.0)).alias("volume")).where("symbol like '%USDT'")


def markets(df: DataFrame, payload: str = "payload", top: int = 10) -> DataFrame:
    """Prediction markets: question, volume and the outcome prices, JSON text inside JSON; the largest by volume."""
    rows = F.from_json(payload, "array<struct<question:string,volume:string,outcomes:string,outcomePrices:string>>")
    x = df.select(F.explode(rows).alias("x")).select("x.question", F.expr("try_cast(x.volume as double)").alias("volume"), F.from_json("x.outcomes", "array<string>").alias("outcomes"), F.from_json("x.outcomePrices", "array<string>").alias("prices"))
    odds = F.transform("prices", lambda p: p.try_cast("double"))
    return x.select("question", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.get(odds, F.lit(0)).alias("yes")).orderBy(F.desc("volume"), "question").limit(top)


def risk_flags(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Token safety: '1' flags as an array, taxes, and a tier."""
    # Fixed names of the flags; the first four alone make a token critical.
    names = ["is_honeypot", "is_blacklisted", "cannot_sell_all", "selfdestruct", "is_mintable", "hidden_owner", "is_proxy", "transfer_pausable"]
    x = F.from_json(payload, "struct<" + ",".join(f"{n}:string" for n in [*names, "buy_tax", "sell_tax"]) + ">")
    d = df.withColumn("x", x)
    flags = F.array_compact(F.array(*[F.when(F.col(f"x.{n}") == "1", F.lit(n)) for n in names]))
    tax = F.greatest(F.coalesce(F.expr("try_cast(x.buy_tax as double)"), F.lit(0.0)), F.coalesce(F.expr("try_cast(x.sell_tax as double)"), F.lit(0.0)))
    critical = F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names[:4]]))
    tier = F.when(critical | (tax >= 0.5), "CRITIQUE").when((F.size(flags) >= 2) | (tax >= 0.1), "ÉLEVÉ").when(F.size(flags) == 1, "MOYEN").otherwise("FAIBLE")
    return d.select(*[c for c in df.columns if c != payload], F.array_join(flags, ",").alias("flags"), tax.alias("tax"), tier.alias("tier"))


def calendar(df: DataFrame, now: int, hours: float, countries: list[str], least: int = 3) -> DataFrame:
    """Events of enough impact ahead within so many hours: title, country, rank, hours_until, in order."""
    rank = F.when(F.col("impact") == "High", 3).when(F.col("impact") == "Medium", 2).when(F.col("impact") == "Low", 1).otherwise(0)
    until = (F.col("t") - now) / 3600
    out = df.select("*", rank.alias("rank"), until.alias("hours_until"))
    return out.where((F.col("rank") >= least) & F.col("country").isin(countries) & F.col("hours_until").between(0, hours)).orderBy(F.asc_nulls_last("hours_until"), "title")


def notes(df: DataFrame, text: str = "text") -> DataFrame:
    """Front matter of a note: id, category, action, target, source and the body."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit("")).alias(k)
    return df.select(*[c for c in df.columns if c != text], *[field(k) for k in ("id", "category", "action", "target", "source")], F.trim(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)).alias("body"))


def quote_changes(df: DataFrame) -> DataFrame:
    """Last value and its change in percent of each name, turned for inverted quotes."""
    top = F.sort_array(F.collect_list(F.struct("t", "value")), asc=False)
    g = df.groupBy("name", "inverted").agg(F.slice(top, 1, 2).alias("s"))  # bounded by what is handed in: two days of quotes
    last, was = F.get(F.col("s.value"), 0), F.get(F.col("s.value"), 1)
    change = (last - was) / was * 100
    return g.select("name", last.alias("last"), F.when(was != 0, F.when(F.col("inverted"), -change).otherwise(change)).alias("change_pct"))
