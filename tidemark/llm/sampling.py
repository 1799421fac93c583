"""Bounded samples of labelled rows, for classifiers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows of each class that a classifier is fitted on at most, and the longest text among them.
PER_CLASS = 1500
MAX_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list[bytes], list[int], dict[int, int]]:
    """Texts, their labels, and how many labelled rows each class has, without the held-out rows (remainder 2 of 4).

    Rows of each class come in the order of a hash of doc_id. A doc_id labelled twice has the greater label; one with
    several rows in docs has the least text. Null ids and labels, and texts over max_chars, are left out.
    """
    known = (
        labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
        .groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = (
        docs.select("doc_id", docs["text"].cast("string").alias("text")).where(F.length("text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")  # 2 * per_class rows at most
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("doc_id").collect()
    )
    return [r["text"].encode() for r in rows], [r["label"] for r in rows], sizes


def class_weights(labels, sizes: dict[int, int]):
    """Weights that give each class of the sample its share of all labelled rows; the mean weight is 1."""
    import numpy as np

    y = np.asarray(labels)
    have = np.array([max(1, int((y == c).sum())) for c in (0, 1)], float)
    share = np.array([sizes.get(0, 0), sizes.get(1, 0)], float)
    w = (share / max(1.0, share.sum()) / have)[y] if len(y) else np.zeros(0)
    return w / w.mean() if len(y) and w.sum() else w
