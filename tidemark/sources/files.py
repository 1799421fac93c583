"""Files in and out: tolerant scans, appends, swaps, retention, backfill."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local session gets a folder of its own (tests); on a cluster that would be read by none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own_folder[0]


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, so that any store Spark reads will do."""
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns by header; a missing file is an empty table."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def accepted(rows: DataFrame) -> DataFrame:
    """Rows whose status is accepted; the filter reaches the scan."""
    return rows.where(F.col("status") == "ACCEPTÉ")


def append(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None) -> None:
    """Add rows; Spark writes a header in each CSV part, so readers see one."""
    w = df.write.mode("append").option("header", True)
    (w.partitionBy(*partition) if partition else w).format(kind).save(path)


def swap(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None) -> None:
    """Replace a folder: write beside it, then rename; readers see the old rows or the new ones."""
    spark = df.sparkSession
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    w = df.write.option("header", True)
    (w.partitionBy(*partition) if partition else w).format(kind).save(fresh)
    fs, p, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), p)
    if fs.exists(old):
        fs.delete(old, True)


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Rows of a line-wise journal; lines that aren't JSON, or lack a required field, are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path)
    rows = lines.select(F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    for c in required or []:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_documents(df: DataFrame, path: str, key: str, order: str) -> None:
    """One JSON array for each key, in a folder of its own (key=...), its rows in order. A key's rows must fit in one document."""
    rest = [order, *[c for c in df.columns if c not in (key, order)]]
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("value")
    swap(df.groupBy(key).agg(body), path, "text", [key])


def tail(df: DataFrame, n: int, by: Column) -> DataFrame:
    """The last n rows in an order, by a top-k and not a full sort."""
    return df.orderBy(by.desc()).limit(n)


def retain(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in the order, most at most: a ring buffer without state."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def backfill(have: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of downloaded pages that are not had yet, each key once; what repeats across pages is the least row."""
    rest = [c for c in pages.columns if c not in keys]
    new = pages.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return new.join(have.select(*keys).distinct(), keys, "left_anti")


def first_source(sources: list[tuple[DataFrame, int]], keys: list[str]) -> DataFrame:
    """For each key, the rows of the first source that has at least so many of them."""
    out = None
    for place, (df, least) in enumerate(sources):
        n = F.count("*").over(Window.partitionBy(*keys))
        part = df.withColumn("_n", n).where(F.col("_n") >= least).drop("_n").withColumn("_source", F.lit(place))
        out = part if out is None else out.unionByName(part)
    best = F.min("_source").over(Window.partitionBy(*keys))
    return out.withColumn("_best", best).where("_source = _best").drop("_best").withColumnRenamed("_source", "source")
