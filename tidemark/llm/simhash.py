"""SimHash near-dedup: segment bit counts as a grid, a range join on it, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, discard, pieces

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: 32 segments of 2 bits; a segment's count of ones (0 to 2) fits its own 2 bits of one long.
SEGMENTS = 32
LOW = 0x5555555555555555
EDGES_A_FILE = 200_000


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    count, total = np.zeros(64, np.int64), len(starts)
    for k in range(0, total, 1 << 16):
        some = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)], "<u8")
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        prints = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "mark", "print"])


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def grid_cell(bits: Column) -> Column:
    """The counts of ones in all segments, side by side in one long."""
    even, odd = bits.bitwiseAND(_long(LOW)), F.shiftrightunsigned(bits, 1).bitwiseAND(_long(LOW))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # their sum, without a carry


def cells_within_one(cell: Column) -> Column:
    """The cell and those at Manhattan distance 1. Two counts at distance 2 or less share one of these.

    In a field of two bits, 0 and 1 differ by 01, 1 and 2 by 11.
    """
    out = [cell]
    for k in range(SEGMENTS):
        here = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
        out += [F.when(here != 2, cell.bitwiseXOR(_long(1 << (2 * k)))), F.when(here != 0, cell.bitwiseXOR(_long(3 << (2 * k))))]
    return F.array_compact(F.array(*out))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that a, b edges lead to. Stars to the least neighbour, in turns, until they hold."""
    spark, before = edges.sparkSession, None
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(lower.hint("merge"), F.col("a") == F.col("u"))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(met.select("a", F.col("m").alias("b"))).distinct()
        # as many files as the edges need, so that rounds over few edges are not many tiny tasks
        spent, edges = edges, cut(small.coalesce(max(1, before[0] // EDGES_A_FILE)) if before else small, "edges")
        discard(spent)
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen


def close_prints(prints: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """a, b of the distinct values in print: steps of 2 bits at most that lead from each to all that such steps reach.

    And the tables they are read from, to be discarded by who has read them. The grid, its range join and the exact check
    are those of near_duplicates.
    """
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    celled = prints.select("print").repartition(parts).select("print", grid_cell(F.col("print")).alias("cell"))
    placed = celled.select("print", F.explode(cells_within_one(F.col("cell"))).alias("cell"))
    met = placed.groupBy("cell").agg(F.min("print").alias("hub"), F.max("print").alias("last")).where("hub < last").select("cell", "hub")
    met = cut(met, "met")
    near = cut(placed.join(met.hint("merge"), "cell").select("print", "cell", "hub"), "near")  # candidates: a class and its cell's hub
    differ = F.bit_count(F.col("print").bitwiseXOR(F.col("hub")))
    links = cut(near.where((F.col("print") != F.col("hub")) & (differ <= MOST_BITS)).select(F.col("print").alias("a"), F.col("hub").alias("b")).distinct(), "links")
    linked = cut(components(links), "linked")
    # Cells that still hold two groups: their classes are checked against all others there, without pairs, by the values
    # within one bit of each: two fingerprints differ in 2 bits at most if and only if they share one.
    placed_roots = near.select("print", "cell").join(linked.hint("merge"), F.col("print") == F.col("node"), "left").select("print", "cell", F.coalesce("root", "print").alias("root"))
    open_ = placed_roots.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("cell")
    rest = cut(placed_roots.join(open_.hint("merge"), "cell", "left_semi").select("print").distinct(), "rest")
    points = rest.repartition(parts).select("print", F.explode(F.array(F.col("print"), *[F.col("print").bitwiseXOR(_long(1 << i)) for i in range(64)])).alias("point"))
    hubs = cut(points.groupBy("point").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo < hi").select("point", "lo"), "hubs")
    more = points.join(hubs.hint("merge"), "point").where("print <> lo").select(F.col("print").alias("a"), F.col("lo").alias("b"))
    discard(met, near)
    return links.union(more).distinct(), (links, rest, hubs)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, mark (hash of the text), print (long), root, component_id; a row for each row of docs.

    root is the least fingerprint of the component.

    Fingerprints that differ in most_bits (2) bits or fewer link; component_id is the least doc_id reachable.
    Equal fingerprints are one class from the start. The bit counts of 32 segments place each class in a grid; the
    Manhattan distance of counts never exceeds the bits that differ, so classes that share no cell within one step
    of both can't link. That range join names the candidates: each class and the least one of each cell it shares, of
    which those stay whose bits differ in 2 places at most. Cells that then still hold two groups are checked in whole:
    two fingerprints differ in at most 2 bits if and only if some value is within 1 bit of both, and each class is led
    to the least one at each such value. So a group of any size costs rows in proportion to its members, never to its
    pairs, and no link is lost.

    Null and blank texts have fingerprint 0 and link like others. Null doc_id: linked, never a component_id unless
    no member has an id (then null). Repeated rows each get a row. Only doc_id and text are read. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    if most_bits != 2:
        raise ValueError("grid and check are laid out for 2 bits")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, mark bigint, print bigint"
    text = docs["text"].cast("string")
    printed = cut(docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(lambda batches: _fingerprints(batches, shingle), schema), "prints")
    classes = cut(printed.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    edges, spent = close_prints(classes)
    linked = components(edges)
    discard(*spent)
    rooted = classes.join(linked, classes["print"] == linked["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("print", "root", "component_id")
    return printed.join(named, "print").select("doc_id", "mark", "print", "root", "component_id")


def op1_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
