"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every white-space character the contracts name: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

_written: list[str] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Unlike checkpoint(), the plan runs once, and what is read back survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read any more."""
    for df in tables:
        path = df._tidemark_path
        _written.remove(path)
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote in this process; results that read them must be done with."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now.

    Spark drops them once the driver's JVM has collected the plans that made them, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Remembered(dict):
    """fn of a key, kept for a bounded number of keys; reads by map() stay in C."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is the faster way where every character is ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(docs: DataFrame, name: str = "text") -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def pieces(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows and bytes, about, that sent() broadcasts at most.
MOST_ROWS, MOST_BYTES = 1_000_000, 32_000_000


def sent(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is counted small, in rows and in bytes of its values; else as it is, so joins shuffle.

    What is read of a larger table to find out is most_rows rows and one.
    """
    most_rows = MOST_ROWS if most_rows is None else most_rows
    fixed = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
    width = lambda c, t: F.lit(16) if t in fixed else F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
    size = sum((width(c, t) for c, t in df.dtypes), F.lit(0)).cast("long")
    n, held = df.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and held <= MOST_BYTES else df
