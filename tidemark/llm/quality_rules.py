"""Quality rules: counted rules, then divergence of a document's histograms from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, pieces, sent

MIN_WORDS, MAX_REPEAT = 10, 20
#: Texts of fewer words are not held against a histogram of characters, of words.
GUARD_CHARS, GUARD_WORDS = 40, 80
#: Jensen-Shannon distance (the root of the divergence) of character classes.
MOST_CHARS = 0.28
#: Of the distance that a text without any common word has from the same reference (0.43 on sf0.1).
MOST_WORDS = 0.95
COMMON = 64
#: Words that a language's reference is counted from, at least. Texts of a language with fewer are not held against any.
LEAST_WORDS = 2000
#: References that go to the executors as they are, at most (about 2 KB each); beyond that they join the texts by language.
MOST_REFERENCES = 10_000
#: A word below this share of a language's words is not common, so 2,000 a language are ranked at most.
LEAST_WORD = 0.0005
HELD = 200_000
CLASSES = 7  # a-z, A-Z, 0-9, blank, sentence marks, other ASCII, beyond ASCII


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[list(b" \t\n\x0b\x0c\r")], table[list(b".,;:?!'\"()-")] = 3, 4
    table[128:], table[128:192] = 6, CLASSES  # bytes that continue a character are no character
    return table


CLASS_OF = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES] if text else np.zeros(CLASSES, np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon, base 2, of two histograms of the same bins, 0 to 1; 0 where one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, n: counts of lower-cased words, and of character classes under the keys ' 0' to ' 6'."""

    def out(words: Counter) -> pa.RecordBatch:
        keys = list(words)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([words[k] for k in keys], pa.int64())], names=["lang", "key", "n"])

    held: dict[str | None, Counter] = {}
    flat = lambda: Counter({(lang, w): n for lang, c in held.items() for w, n in c.items()})
    for batch in pieces(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            c = held.setdefault(lang, Counter())
            c.update((text or b"").lower().split())
            for k, n in enumerate(class_counts(text or b"").tolist()):
                if n:
                    c[b" %d" % k] += n
        if sum(map(len, held.values())) > HELD:
            yield out(flat())
            held = {}
    if held:
        yield out(flat())


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """lang, classes (counts), keys, counts (of the commonest words), words (all); a row for each language of LEAST_WORDS words, counted over all rows."""
    counted = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).mapInArrow(_counted, "lang string, key binary, n bigint")
    sums = cut(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")), "counts")
    special = F.substring("key", 1, 1) == F.lit(b" ")
    per = sums.groupBy(F.col("lang").alias("l")).agg(F.sum(F.when(~special, F.col("n"))).alias("words"), *[F.coalesce(F.max(F.when(F.col("key") == F.lit(b" %d" % k), F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(CLASSES)])
    per = cut(per.where(F.col("words") >= LEAST_WORDS).select("l", "words", F.array(*[f"c{k}" for k in range(CLASSES)]).alias("classes")), "languages")
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")
    ranked = (
        sums.where(~special).join(sent(per.select("l", "words")), F.col("lang").eqNullSafe(F.col("l"))).where(F.col("n") >= LEAST_WORD * F.col("words"))
        .withColumn("k", F.row_number().over(top)).where(F.col("k") <= common)
        .groupBy(F.col("lang").alias("m")).agg(F.sort_array(F.collect_list(F.struct("k", "key", "n"))).alias("top"))
    )
    return per.join(ranked, F.col("l").eqNullSafe(F.col("m")), "left").select(
        F.col("l").alias("lang"), "classes", F.coalesce(F.col("top.key"), F.array().cast("array<binary>")).alias("keys"), F.coalesce(F.col("top.n"), F.array().cast("array<bigint>")).alias("counts"), "words"
    )


class Reference:
    """A language's histograms, and how far a text of it may be from the one of words."""

    def __init__(self, classes, keys, counts, words):
        self.classes, self.keys = np.array(classes, float), [bytes(k) for k in keys]
        self.shares = np.array([*counts, max(0, words - sum(counts))], float)
        self.most = MOST_WORDS * distance(np.append(np.zeros(len(self.keys)), 1.0), self.shares)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 5 words that the text has twice or more."""
    n = len(words)
    if n < 6:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    key = np.zeros(n - 4, np.uint64)
    for j in range(5):
        key = (key ^ ids[j : n - 4 + j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    twice = np.flatnonzero(pd.Series(key).duplicated(keep=False).to_numpy())
    if not len(twice):
        return 0
    rows = np.stack([ids[twice + j] for j in range(5)], axis=1)  # equal hashes are held against the words themselves
    _, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    marks = np.zeros(n + 1, np.int64)
    sure = twice[counts[back.ravel()] > 1]
    np.add.at(marks, sure, 1)
    np.add.at(marks, sure + 5, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def rules(text: bytes, ref: Reference | None) -> tuple:
    words = text.split()
    n = len(words)
    letters = text.translate(None, b" \t\n\x0b\x0c\r")
    word_chars = len(letters) if letters.isascii() else len(letters.decode())
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT * n
    chars = wordy = 0.0
    if ref is not None and n >= GUARD_CHARS:
        chars = distance(class_counts(text), ref.classes)
    if ref is not None and n >= GUARD_WORDS:
        c = Counter(text.lower().split())
        own = np.array([c.get(k, 0) for k in ref.keys], float)
        wordy = distance(np.append(own, n - own.sum()), ref.shares)
    kept = not failed and chars <= MOST_CHARS and (ref is None or wordy <= ref.most)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, failed, chars, wordy, kept


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
TYPES = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS; a row for each row of docs.

    kept is false if a base rule fails, or if the reference of the row's own language is further than MOST_CHARS from
    the histogram of its character classes (texts of GUARD_CHARS words or more), or further than MOST_WORDS of what a
    text without common words has from the histogram of its common words (GUARD_WORDS or more). References are counted
    over all rows, by lang; a language of fewer than LEAST_WORDS words has none, and its texts pass both.

    Null text: no words, so base_failed. Null lang: a language of its own. Repeated rows each get a row.
    Only doc_id, text and lang are read. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    refs = cut(references(docs), "references")
    asked = docs.select("doc_id", docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    held = None
    if refs.count() <= MOST_REFERENCES:
        held = spark.sparkContext.broadcast({r["lang"]: Reference(r["classes"], r["keys"], r["counts"], r["words"]) for r in refs.collect()})
    else:
        kinds = refs.select(F.col("lang").alias("l"), F.struct("classes", "keys", "counts", "words").alias("ref"))
        asked = asked.join(kinds, F.col("lang").eqNullSafe(F.col("l")), "left").select("doc_id", "text", "lang", "ref")

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value if held is not None else {}
        for batch in pieces(batches):
            langs = batch.column(2).to_pylist()
            if held is None:
                known = {k: Reference(**r) for k, r in dict(zip(langs, batch.column(3).to_pylist(), strict=True)).items() if r}
            rows = [rules(t or b"", known.get(lang)) for t, lang in zip(batch.column(1).cast(pa.binary()).to_pylist(), langs, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)]], names=["doc_id", *COLUMNS])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return asked.mapInArrow(ruled, schema)


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    return quality(docs)
