"""Line dedup: normalised lines that several documents hold stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, text_of

MIN_CHARS = 10
#: A key is hot from this share (one in so many) of all lines on, and from so many lines on.
HOT_KEYS = 1000
HOT_LINES = 500


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    text = text_of(docs)
    own = F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]) if carry else F.lit(None).cast("int")
    row = F.struct(docs["text"].isNull().alias("was_null"), own.alias("own"))
    return docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), row.alias("row"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, carry: list[str] | None = None) -> DataFrame:
    r"""Drop repeated lines: doc_id, kept (the text that stays), n_lines, n_dropped; a row for each row of docs.
    row is a struct of was_null (the text) and own, a struct of the columns of docs named in carry.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of min_chars code points or more
    that two or more documents hold lose all their lines but those of the smallest doc_id.

    Null or empty text: one empty line, kept. Null doc_id: all such rows are one document that never keeps a shared
    line if a row with an id holds it. Rows that repeat a doc_id are one document and each gets its own result.
    Repeats of a line inside its keeping document stay. Only doc_id and text are read, so other columns can't clash.
    Empty table: no rows.
    """
    base = _keyed(docs, carry or [])
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    lines = cut(
        base.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "mark", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "mark", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("digest")),
        "lines",
    )
    shared = cut(
        lines.groupBy("digest")
        .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.count("*").alias("n"))
        .where((F.col("keeper") < F.col("other")) | (F.col("nameless") & F.col("keeper").isNotNull()))
        .select("digest", "keeper", "n"),
        "shared",
    )
    # A key of a thousandth of all lines or more is hot. There are a thousand such at most, so they are broadcast and
    # their lines stay where they are; the others' lines meet their keys in a shuffle that no key can tilt.
    hot = F.col("n") >= max(HOT_LINES, lines.count() / HOT_KEYS)
    often = F.broadcast(shared.where(hot).select("digest", "keeper"))
    found = lines.join(often, "digest").unionByName(lines.join(often, "digest", "left_anti").join(shared.where(~hot).select("digest", "keeper"), "digest"))
    drops = (
        found.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    # The text side is streamed past a hash table of drop lists, so whole texts are never sorted.
    met = base.join(drops.hint("shuffle_hash"), base["doc_id"].eqNullSafe(F.col("d")) & (base["mark"] == F.col("m")), "left")
    split = F.split("text", "\n")
    stays = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"), lambda i: F.get(F.col("all"), i)), "\n")
    )
    return (
        met.withColumn("all", split)
        .select("doc_id", "row", stays.alias("kept"), F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(s.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
