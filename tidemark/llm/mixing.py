"""Mixing sources to target weights by Efraimidis-Spirakis keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "tidemark-mix-1"
#: Rows that one in-order prefix sum gets, about.
RUN_ROWS = 4096
#: Characters that lower a document's quality weight.
NOISE = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """1 for a text free of NOISE characters, falling to 1/21 for one of nothing else."""
    share = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(F.length(text), F.lit(1))
    return 1.0 / (1.0 + 20.0 * share)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of md5 of the id and the seed, so that reruns agree."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, n_docs -> with target. One row for each source; sorted whole, as the weights go by rank.

    A source whose fair share passes most times its size is filled up, in the order of size for weight; what is left
    is shared by weight among the others.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    open_ = F.col("cap") > F.col("level") * F.col("weight")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("place"))).over(whole)
    return ranked.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED, quality: Column | None = None, carry: bool = False) -> DataFrame:
    """doc_id, source, mark (hash of the text), size, source_size, target, taken; a row for each row of docs.

    quality: the documents' weights, above 0, as a column of docs; quality_weight() of the text if none is given.
    carry: whole rows of docs come along, in a struct named row.

    size is the number of words. A source first gives all its documents as many whole times as its target holds
    its size; the rest of the target goes to its documents in the order of -ln(u) / quality weight, the last one
    in part.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: keyed as the empty
    string. Ties, so also repeated rows, go by doc_id and text hash, and each row is taken for itself. A source of
    no words has target 0. Only doc_id, text and source are read. Empty table: no rows.
    """
    text = text_of(docs)
    priority = -F.log(uniform(docs["doc_id"], seed)) / (quality_weight(text) if quality is None else F.coalesce(quality.cast("double"), F.lit(1e-9)))
    rows = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    sized = cut(
        docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.xxhash64(text).alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), priority.alias("priority"), *rows),
        "sized",
    )
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most)
    per_source = cut(per_source, "targets")
    goal = per_source.select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    runs = F.greatest(F.ceil(F.col("n_docs") / RUN_ROWS), F.lit(1))
    # 1 - exp(-priority) rises with the priority and lies in [0, 1): its runs follow the order that is summed.
    run = F.least(F.floor(runs * (1 - F.exp(-F.col("priority")))), runs - 1).cast("long")
    dealt = sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("run", run).drop("s", "n_docs")
    before = Window.partitionBy("rs").orderBy("rr").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(F.col("source").alias("rs"), F.col("run").alias("rr")).agg(F.sum("size").alias("in_run"))
        .withColumn("start", F.coalesce(F.sum("in_run").over(before), F.lit(0))).drop("in_run")
    )
    within = Window.partitionBy("source", "run").orderBy("priority", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    ahead = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        dealt.join(starts, F.col("source").eqNullSafe(F.col("rs")) & (F.col("run") == F.col("rr")))
        .withColumn("extra", F.least(F.col("size"), F.greatest(rest - ahead, F.lit(0))))
        .select("doc_id", "source", "mark", "size", "source_size", "target", (epochs * F.col("size") + F.col("extra")).cast("long").alias("taken"), *(["row"] if carry else []))
    )


def op5_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':tidemark-mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + 20.0 * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1)))) AS priority
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM r),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM v WHERE cap > level * weight ORDER BY place LIMIT 1) * weight), cap) AS target FROM v),
j AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY priority, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (epochs * size + least(size, greatest(round(target - epochs * source_size)::BIGINT - ahead, 0)))::BIGINT AS taken
FROM j
"""
