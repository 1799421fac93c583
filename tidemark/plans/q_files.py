"""Files written and read back: scans, appends, swaps, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files
from .registry import query
from .views import BARS, JOURNAL

JO = "WITH " + JOURNAL


def _folder(v) -> str:
    return f"{files.shared_folder(v.spark)}/tidemark/files-{uuid.uuid4().hex}"


@query("s1_csv_scan", JO + " SELECT event_id, symbol, status, nullif(rsi, '') AS rsi FROM journal")
def _(v):
    """A journal as CSV, text columns by header, blanks null; beside it a journal that does not exist yet, which is empty."""
    at, columns = _folder(v), ["event_id", "symbol", "status", "rsi"]
    files.append(v.journal.select(*[F.col(c).cast("string") for c in columns]), at + "/journal", "csv")
    rows = files.csv_rows(v.spark, at + "/journal", columns).unionByName(files.csv_rows(v.spark, at + "/none", columns))
    return rows.withColumn("event_id", F.col("event_id").cast("bigint")).select("event_id", "symbol", "status", F.nullif("rsi", F.lit("")).alias("rsi"))


@query("s3_csv_append", JO + " SELECT symbol, status, count(*) AS n FROM journal GROUP BY 1, 2")
def _(v):
    """Three appends to one journal; no header comes back as a row."""
    at, columns = _folder(v), ["event_id", "symbol", "status"]
    for k in range(3):
        files.append(v.journal.where(F.col("event_id") % 3 == k).select(*columns), at, "csv")
    return files.csv_rows(v.spark, at, columns).groupBy("symbol", "status").agg(F.count("*").alias("n"))


@query("s4_atomic_overwrite", JO + " SELECT event_id, status FROM journal WHERE status = 'ACCEPTÉ'")
def _(v):
    """A table of all rows, replaced whole by its accepted ones."""
    at = _folder(v)
    rows = v.journal.select("event_id", "status")
    files.swap(rows, at)
    files.swap(files.accepted(v.spark.read.schema(rows.schema).parquet(at)), at)
    return v.spark.read.schema(rows.schema).parquet(at)


@query("s7_json_documents", "WITH " + BARS + " SELECT symbol, t, round(close, 6) AS close, volume FROM bars")
def _(v):
    """A document of bars for each symbol, one JSON array a file, written and read back."""
    at = _folder(v)
    files.write_documents(v.bars.select("symbol", "t", "close", "volume"), at, "symbol", "t")
    rows = files.json_document(v.spark, at, "symbol string, t bigint, close double, volume double")
    return rows.select("symbol", "t", F.round("close", 6).alias("close"), "volume")
