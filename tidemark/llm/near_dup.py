"""Near-dedup by the Jaccard similarity of 5-word shingle sets.

Candidates are named twice. First as in op1: fingerprints of the sets, the counts of their segments as a grid, the range
join on it. Texts near by Jaccard may differ in ten bits and more, which no such grid can reach; so a prefix join names
those that are not in one group by then. The set of a text is a bit vector too; its bits are counted in segments, and the
Manhattan distance of two texts' counts, a lower bound of the bits that differ, drops most pairs. What is left of either
is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Remembered, cut, discard, pieces, release
from .simhash import close_prints, components, majority

SHINGLE = 5
#: Sets are near if their intersection is at least NUM / DEN of their union.
NUM, DEN = 4, 5
#: Texts must share a MARGINth of their shingles within prefixes that are longer by as much.
MARGIN = 20
#: One text in SAMPLE is counted for the order of shingles; those in OFTEN sampled texts or more come last.
SAMPLE, OFTEN, MOST_OFTEN = 16, 8, 200_000
#: Segments that the bits of a set are counted in; a count is a byte, 255 standing for more.
SEGMENTS = 256
HELD_WORDS = 200_000
FACTOR = 0x9E3779B97F4A7C15


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def shingles(text: bytes, held: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """The set of 64-bit hashes of the word shingles, in order. A text of fewer words is one shingle; blank texts share one."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(FACTOR) + h[j : len(h) - width + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def shared_least(n):
    """Prefixes are long enough to share so many elements, not one, so that texts with a mere passage in common are no candidates."""
    return n // MARGIN + 1


def prefix_length(n: int) -> int:
    """Near sets have NUM / DEN of either in common, at least. Whatever order both are in, the first shared_least of these
    (or all, if they are fewer) are among the first so many of either set: only the rest of the common ones follow."""
    return min(n, n - -(-NUM * n // DEN) + shared_least(n))


def _prefix(s: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    if not len(often):
        return s[: prefix_length(len(s))]
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    return s[np.argsort(np.where(often[at] == s, times[at], 0), kind="stable")[: prefix_length(len(s))]]


def _long_lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Remembered(_word_hash, HELD_WORDS)
    for batch in pieces(batches, 64):
        sets = [shingles(t, held) for t in _texts(batch, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["token"])


def profile(s: np.ndarray) -> bytes:
    """Counts of the set's elements by segment. Capping a count never raises a difference, so distances stay lower bounds."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b whose profiles differ by no more than near sets of n and m elements can: (n + m) * (DEN - NUM) / (DEN + NUM)."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for k in (4, 5))
        keep = pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) * (NUM + DEN) <= (n + m) * (DEN - NUM))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def near(n: Column, m: Column, both: Column) -> Column:
    return both * (NUM + DEN) >= (n + m) * NUM


def _enough() -> Column:
    """Elements that near sets of n and m share at the positions of within(), at least."""
    return F.floor(F.least("n", "m") / MARGIN) + 1


def within() -> Column:
    """Whether two sets of n and m elements, of like size, can be near if their shared element at positions i and k is one of the first.

    Near sets have at least so many in common: `least`. Before the s-th shared element of a set there are s - 1 shared
    ones, so at its position i no more than s - 1 + n - i are shared in all. What stands later is no evidence.
    """
    least = F.ceil((F.col("n") + F.col("m")) * NUM / (NUM + DEN))
    like = F.least("n", "m") * DEN >= F.greatest("n", "m") * NUM
    return like & (F.col("i") <= F.col("n") - least + _enough() - 1) & (F.col("k") <= F.col("m") - least + _enough() - 1)


def _candidates(met: DataFrame) -> DataFrame:
    """a, b of the rows a, b, n, m (sizes), one for each element that they share within(), that share enough."""
    size = met.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("shared"))
    return size.where(F.col("shared") >= _enough()).select("a", "b")


def by_fingerprints(profiles: DataFrame) -> DataFrame:
    """a < b of the rows class, print: each class with the least of its fingerprint, and those with each other that are led
    together in steps of 2 bits at most. Written. As many rows as classes and steps, not as pairs."""
    firsts = cut(profiles.groupBy("print").agg(F.min("class").alias("hub")), "firsts")
    edges, spent = close_prints(firsts.select("print"))
    one, two = (firsts.select(F.col("print").alias(p), F.col("hub").alias(h)) for p, h in (("a", "x"), ("b", "y")))
    across = edges.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    alike = profiles.join(firsts, "print").where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b"))
    out = cut(alike.union(across).distinct(), "fingers")
    discard(firsts, *spent)
    return out


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs a, b that are not in one of the groups yet."""
    one, two = (groups.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("a", "x"), ("b", "y")))
    met = pairs.join(one, "a", "left").join(two, "b", "left")
    return met.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), root; a row for each row of docs. Rows of one group have one root.

    Texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more link; groups are what links reach.
    Equal sets are one class. Near sets share a twentieth of their shingles within the first quarter of each, in any
    order common to all; here shingles that a sample finds often come last, so that passages which many texts share name
    no candidates. Candidates are held against each other by their whole sets of 64-bit hashes, so nothing is missed
    and nothing is linked by chance. First those whose fingerprints are led together, which are most copies with small
    changes; then, of what is not in one group by that, each against one class of each shared shingle: that which has it earliest, so has
    the fewest rare shingles and is the likeliest source of copies. That unites large groups at a cost in proportion to
    their members; then all pairs that share enough and are not in one group yet.

    Null and blank texts are alike. Null doc_id: grouped like others. Only doc_id and text are read. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = docs["text"].cast("string")
    own = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    counted = own.where(F.pmod("mark", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "token long").groupBy("token").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(MOST_OFTEN).toPandas()
    keys, times = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    ranks = spark.sparkContext.broadcast((keys[order], times[order]))  # MOST_OFTEN at most

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Remembered(_word_hash, HELD_WORDS)
        for batch in pieces(batches):
            sets = [shingles(t, held) for t in _texts(batch, 2)]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids), pa.array(np.array([len(s) for s in sets], np.int32)), _long_lists([_prefix(s, *ranks.value) for s in sets]), pa.array(map(profile, sets), pa.binary()), pa.array(np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64))],
                names=["doc_id", "mark", "class", "n", "prefix", "profile", "print"],
            )

    id_type = dict(docs.dtypes)["doc_id"]
    printed = cut(own.mapInArrow(prefixed, f"doc_id {id_type}, mark bigint, class bigint, n int, prefix array<bigint>, profile binary, print bigint"), "prefixes")
    placed = printed.select("class", "n", F.posexplode("prefix").alias("i", "token"))
    # Tokens of one class alone go first. A token's hub is the class that has it earliest.
    ends = placed.groupBy("token").agg(F.min(F.struct("i", "class", "n")).alias("hub"), F.min("class").alias("least"), F.max("class").alias("last"))
    ends = cut(ends.where("least < last").select("token", F.col("hub.class").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.i").alias("k")), "ends")
    placed = cut(placed.join(ends.select("token"), "token", "left_semi").distinct(), "placed")
    release(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Remembered(_word_hash, HELD_WORDS)
        for batch in pieces(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), _long_lists([shingles(t, held) for t in _texts(batch, 1)])], names=["class", "set"])

    profiles = cut(printed.groupBy("class").agg(F.first("n").alias("n"), F.first("profile").alias("profile"), F.first("print").alias("print"), F.min(F.struct("doc_id", "mark")).alias("r")), "profiles")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b whose whole sets are near."""
        one = profiles.select(F.col("class").alias("a"), "n", F.col("profile").alias("x"))
        two = profiles.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("profile").alias("y"))
        pairs = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_possible, "a bigint, b bigint"), "pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        asked = profiles.join(needed, "class", "left_semi").select("class", F.col("r.doc_id").alias("i"), F.col("r.mark").alias("j"))
        kept = own.join(asked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("j"))).select("class", "text")
        sets = cut(kept.mapInArrow(whole, "class bigint, set array<bigint>").dropDuplicates(["class"]), "sets")
        release(spark)
        one, two = (sets.select(F.col("class").alias(x), F.col("set").alias(f"s{x}")) for x in ("a", "b"))
        both = F.size(F.array_intersect("sa", "sb"))
        out = cut(pairs.join(one, "a").join(two, "b").where(near(F.size("sa"), F.size("sb"), both)).select("a", "b"), "links")
        discard(sets, pairs)
        release(spark)
        return out

    fingers = by_fingerprints(profiles.select("class", "print"))
    near_prints = linked(fingers)
    groups = components(near_prints)
    release(spark)
    met = placed.join(ends, "token").where("class <> hub").where(within())
    swap = F.col("class") > F.col("hub")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    hubs = cut(apart(_candidates(met.select(either("class", "hub").alias("a"), either("hub", "class").alias("b"), either("n", "m").alias("n"), either("m", "n").alias("m"))), groups), "hubs")
    links = near_prints.union(linked(hubs))
    groups = components(links)
    discard(ends)
    rooted = placed.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    rooted = cut(rooted.join(mixed, "token", "left_semi"), "apart")
    discard(placed)
    a, b = (rooted.select("token", F.col("class").alias(c), F.col("n").alias(n), F.col("i").alias(i), F.col("root").alias(r)) for c, n, i, r in (("a", "n", "i", "x"), ("b", "m", "k", "y")))
    left = _candidates(a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & within()))
    left = cut(left.join(hubs, ["a", "b"], "left_anti"), "left")
    discard(rooted)
    if left.limit(1).count():
        groups = components(links.union(linked(left)))
    discard(profiles, fingers, hubs, left)
    release(spark)
    groups = groups.withColumnRenamed("node", "k")
    return printed.join(groups, F.col("class") == F.col("k"), "left").select("doc_id", "mark", F.coalesce("root", "class").alias("root"))
