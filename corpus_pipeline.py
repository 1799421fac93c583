"""A corpus pipeline of five operators; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dup, quality_model
from tidemark.llm.common import cut, table

#: The classifier and the sampling order are not SQL, so there is no SQL for run(); a brute-force test stands in.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. A doc_id goes if any of its rows is rejected.

    Null and empty texts are scored like others, null ids meet null ids, repeated rows go or stay together.
    Empty table: no rows. Further columns pass, whatever their names.
    """
    scored = quality_model.op9_quality_classifier(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("k")).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["k"]), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another keeps. One of whose lines none or only blanks stay is kept with an empty text.

    Null text: stays null. n_chars is counted anew where lines went. Repeated rows keep their lines alike.
    Empty table: no rows. Further columns pass, whatever their names.
    """
    kept = line_dedup.dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = F.when(F.col("row.was_null") & (F.col("kept") == ""), F.lit(None)).otherwise(F.col("kept"))
    out = {"text": text.cast(dict(docs.dtypes)["text"])}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.own.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return kept.select(*[out[c].alias(c) if c in out else (F.col(c) if c == "doc_id" else F.col(f"row.own.`{c}`")).alias(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard 0.8): that of the least id, null last; of its repeats, the least text hash.

    Null, empty and blank texts are alike, so one of them stays. Repeated rows: one. Empty table: no rows.
    Further columns pass, whatever their names.
    """
    groups = cut(near_dup.near_groups(docs), "groups")
    first = F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("s")
    stay = groups.groupBy("root").agg(first).select("root", F.col("s.doc_id").alias("k"), F.col("s.mark").alias("m"))
    often = groups.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("j")).agg(F.count("*").alias("times")).where("times > 1")
    stay = stay.join(often, F.col("k").eqNullSafe(F.col("i")) & (F.col("m") == F.col("j")), "left").select("k", "m", F.col("times").isNotNull().alias("again"))
    names = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    held = docs.select(docs["doc_id"].alias("d"), F.xxhash64(docs["text"].cast("string")).alias("h"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    held = held.join(stay, F.col("d").eqNullSafe(F.col("k")) & (F.col("h") == F.col("m")))
    return held.where(~F.col("again")).select(*names).union(held.where("again").select("d", "h", "row").dropDuplicates(["d", "h"]).select(*names))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with the benchmark. A doc_id goes if any of its rows does.

    Null and empty texts stay, repeated rows go or stay together. Empty tables: no rows, or nothing goes.
    Further columns pass, whatever their names.
    """
    hit = decontaminate.op6_decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("k")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["k"]), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target and taken: how many of their words it takes, repeats counted.

    Documents of which it takes nothing stay, with taken 0. A column of docs by one of these names is left out.
    Null text: size and taken 0. Null source: a source of its own. Ties, repeated rows: each taken for itself.
    """
    added = ("size", "source_size", "target", "taken")
    return mixing.mix(docs, carry=True).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
