"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, sent, text_of

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN = 10
GRAM = 5
#: k-grams in a winnowing window: a shared span of SPAN words holds a whole one, so it shares its least hash.
WINDOW = SPAN - GRAM + 1
#: Rows that are broadcast at most (and common.MOST_BYTES); beyond that the join shuffles.
MOST_BROADCAST = 1_000_000
#: A document with more fingerprints in common with the items has all its windows looked at, not those around them.
MOST_AROUND = 64


def _hashes(text: Column) -> Column:
    """Of the words, in order."""
    return F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def _hashed(df: DataFrame, id_name: str) -> DataFrame:
    """id, mark, hashes."""
    text = text_of(df)
    return df.select(df[id_name].alias("id"), F.xxhash64(text).alias("mark"), _hashes(text).alias("hashes"))


def _grams(hashes: Column, size: int, salt: int | None = None) -> Column:
    """Hash of each run of size words; empty where there are fewer."""
    parts = lambda i: [F.get(hashes, i + j) for j in range(size)] + ([F.lit(salt)] if salt is not None else [])
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))


def _winnowed(df: DataFrame) -> DataFrame:
    """Adds prints: the least gram hash of every window of WINDOW grams, each once."""
    df = df.withColumn("grams", _grams(F.col("hashes"), GRAM))
    least = F.when(
        F.size("grams") >= WINDOW,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("grams") - WINDOW), lambda i: F.least(*[F.get(F.col("grams"), i + j) for j in range(WINDOW)]))),
    ).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("prints", least).drop("grams")


def _windows(df: DataFrame, sizes: list[int], starts: Column | None = None) -> DataFrame:
    """A row for each run of a size in sizes: id, mark, size, pos and two independent hashes of its words.

    starts: for runs of SPAN words, where they begin, instead of everywhere.
    """
    h = F.col("hashes")

    def at(n: int, places: Column) -> Column:
        words = lambda i: [F.get(h, i + j) for j in range(n)]
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("size"), i.alias("pos"), F.xxhash64(*words(i)).alias("a"), F.xxhash64(*words(i), F.lit(7)).alias("b")))

    def of(n: int) -> Column:
        everywhere = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return at(n, everywhere if starts is None or n < SPAN else starts)

    runs = reduce(lambda x, y: F.concat(x, y), [of(n) for n in sizes])
    return df.select("id", "mark", F.explode(runs).alias("w")).select("id", "mark", "w.*")


def _around(met: Column) -> Column:
    """Where the windows begin that hold a gram whose hash is in met: hits extend by what a window can reach either way."""
    last = F.size("hashes") - SPAN
    holds = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(met, g), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(holds, lambda i: F.sequence(F.greatest(i - (SPAN - GRAM), F.lit(0)), F.least(i, last)))))
    return F.when(last < 0, F.array().cast("array<int>")).when(F.size(met) <= MOST_AROUND, near).otherwise(F.sequence(F.lit(0), last))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, mark, n_words, n_hit, item_ids (sorted as strings); a row for each doc_id and text.

    A window is span consecutive words of an item, or the whole of an item of fewer words. A document's words inside
    an occurrence of a window are hit. Any shared window holds a gram that winnowing keeps on both sides, so the
    windows around such a gram are all that can be shared: hits extend from the fingerprint by a window's reach either
    way, are held against the items' windows, and overlapping ones make up whole spans. Items that hold the same window
    are one class, and documents that hit the same classes are one set, whose items are listed once.

    Null or empty text: no words, not hit, and as an item nothing to find. Null doc_id: a value like others. Rows
    that repeat doc_id and text give one row; those with one doc_id and different texts give one each. Repeated
    items and items with one text all count, by distinct item_id; an item with a null id hits words but isn't listed.
    Only doc_id, text and item_id are read. Empty tables: no rows, or no hits.
    """
    if span != SPAN:
        raise ValueError("the fingerprints are laid out for spans of 10 words")
    bench = cut(_hashed(items, "item_id").where(F.size("hashes") > 0).dropDuplicates(["id", "mark"]), "items")
    short = sorted(r[0] for r in bench.where(F.size("hashes") < span).select(F.size("hashes")).distinct().collect())  # 1 to 9 at most
    item_prints = _winnowed(bench).select(F.explode("prints").alias("print"))
    for n in short:
        item_prints = item_prints.union(bench.where(F.size("hashes") == n).select(F.explode(_grams(F.col("hashes"), n, 1000)).alias("print")))
    item_prints = cut(item_prints.distinct(), "prints")
    few = lambda df: sent(df, MOST_BROADCAST)
    words = _winnowed(_hashed(docs, "doc_id"))
    prints = reduce(lambda x, y: F.concat(x, y), [F.col("prints"), *[_grams(F.col("hashes"), n, 1000) for n in short]])
    entry = lambda whole, x: F.struct(F.lit(whole).alias("whole"), x.alias("print"))
    looked = (  # beside its fingerprints, each document has a row of its own, which always stays
        words.select("id", "mark", F.size("hashes").cast("long").alias("n_words"), F.explode(F.concat(F.array(entry(True, F.col("mark"))), F.transform(prints, lambda x: entry(False, x)))).alias("e"))
        .select("id", "mark", "n_words", "e.whole", "e.print")
        .join(few(item_prints.withColumn("found", F.lit(True))), "print", "left").where("whole or found")
        .groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(~F.col("whole"), F.col("print"))).alias("met"))
    )
    looked = cut(looked, "looked")
    suspects = looked.where(F.size("met") > 0).select(F.col("id").alias("sid"), F.col("mark").alias("smark"), "met")
    text = text_of(docs)
    held = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("m"))
    again = held.join(few(suspects), held["doc_id"].eqNullSafe(F.col("sid")) & (F.col("m") == F.col("smark")))
    again = again.dropDuplicates(["doc_id", "m"]).select(F.col("doc_id").alias("id"), F.col("m").alias("mark"), "met", _hashes(F.col("text")).alias("hashes"))
    again = again.withColumn("grams", _grams(F.col("hashes"), GRAM))
    item_windows = _windows(bench, [span, *short])
    if short:  # a short item is one window: the run of all its words
        whole = bench.where(F.size("hashes") < span).select(F.col("id").alias("i"), F.col("mark").alias("k"), F.size("hashes").alias("whole"))
        item_windows = item_windows.join(whole, item_windows["id"].eqNullSafe(whole["i"]) & (item_windows["mark"] == whole["k"]), "left").where(F.col("whole").isNull() | (F.col("whole") == F.col("size"))).select("id", "mark", "size", "pos", "a", "b")
    whose = (
        item_windows.groupBy("size", "a", "b").agg(F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("items"))
        .withColumn("class", F.md5(F.concat_ws("\x00", "items").cast("binary")))
    )
    whose = cut(whose, "windows")
    known = whose.select("size", "a", "b", "class")
    hits = cut(_windows(again, [span, *short], _around(F.col("met"))).join(few(known), ["size", "a", "b"]), "hits")
    along = Window.partitionBy("id", "mark").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("pos") + F.col("size")).over(along), F.lit(0))
    covered = (
        hits.withColumn("new", F.greatest(F.col("pos") + F.col("size") - F.greatest(reached, F.col("pos")), F.lit(0)))
        .groupBy("id", "mark").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    sets = hits.groupBy("id", "mark").agg(F.sort_array(F.collect_set("class")).alias("classes")).withColumn("set", F.md5(F.concat_ws(",", "classes").cast("binary")))
    sets = cut(sets, "sets")
    listed = whose.groupBy("class").agg(F.first("items").alias("items"))
    named = (
        sets.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class"))
        .join(listed, "class").select("set", F.explode("items").alias("item"))
        .groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    found = sets.join(named, "set").select("id", "mark", "item_ids")
    both = covered.join(found.select(F.col("id").alias("fid"), F.col("mark").alias("fmark"), "item_ids"), F.col("id").eqNullSafe(F.col("fid")) & (F.col("mark") == F.col("fmark")), "left")
    both = both.select(F.col("id").alias("hid"), F.col("mark").alias("hmark"), "n_hit", "item_ids")
    return looked.join(both, F.col("id").eqNullSafe(F.col("hid")) & (F.col("mark") == F.col("hmark")), "left").select(
        F.col("id").alias("doc_id"), "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def op6_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
b AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
d AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp),
h AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM d JOIN b USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
