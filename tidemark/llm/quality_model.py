"""Quality classifier: random-indexing word vectors, pooled, a two-layer network, a temperature."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Remembered, held_out, pieces
from .sampling import class_weights, labelled_sample

DIM, NONZERO, SPAN = 48, 6, 2
VOCABULARY, LEAST = 20_000, 5
HIDDEN, EPOCHS, RATE = 24, 120, 0.02
THRESHOLD = 0.7
HELD = 200_000
_SHAPE = bytes.maketrans(bytes(range(128, 256)), b"\xff" * 128)


def index_vector(name: bytes) -> np.ndarray:
    """A sparse vector of 1 and -1 drawn by the name alone."""
    rng = np.random.default_rng(zlib.crc32(name) + (len(name) << 32))
    v = np.zeros(DIM, np.float32)
    v[rng.permutation(DIM)[:NONZERO]] = rng.choice(np.array([-1.0, 1.0], np.float32), NONZERO)
    return v


_LETTERS = {**{c: b"a" for c in range(97, 123)}, **{c: b"A" for c in range(65, 91)}, **{c: b"0" for c in range(48, 58)}, **{c: b"e" for c in range(128, 256)}}


def shape(word: bytes) -> bytes:
    """Kinds of characters with runs as one, and a rough length: for words that the vocabulary lacks."""
    out, last = [], b""
    for c in word[:200]:
        k = _LETTERS.get(c, bytes([c]))
        if k != last:
            out.append(k)
        elif k not in (b"a", b"A", b"0", b"e") and (len(out) < 2 or out[-2] != k):
            out.append(k)
        last = k
    return b"\x00" + b"".join(out[:12]) + b"%d" % min(4, len(word) // 4)


def profile(words: list[bytes]) -> list[bytes]:
    """Pseudo-words of a whole text: its rough length, and how much of it is distinct."""
    n = len(words)
    return [b"\x01n%d" % n.bit_length(), b"\x01d%d" % (10 * len(set(words)) // n if n else -1)]


class Model:
    """Vectors of vocabulary words and of shapes, and the network over a pooled text."""

    def __init__(self, texts: list[bytes], labels: list[int], sizes: dict[int, int]):
        y = np.array(labels, float)
        self.prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
        self.net, self.ids, self.shapes = None, {}, {b"\x02same": 0, b"\x02other": 1}
        if len(set(labels)) < 2:
            return
        split = [t.split() for t in texts]
        counts = Counter(w for ws in split for w in ws)
        words = [w for w, n in counts.most_common(VOCABULARY) if n >= LEAST]
        self.ids = {w: i for i, w in enumerate(words)}
        names = words + sorted({shape(w) for w in counts if w not in self.ids}) + [b"\x02same", b"\x02other"]
        self.shapes = {n: i for i, n in enumerate(names) if i >= len(words)}
        base = np.stack([index_vector(n) for n in names])
        kept = self.cache()
        self.vectors = self._learn([self.encode(ws, kept) for ws in split], base)
        x = np.stack([self.pool(ws, kept) for ws in split])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self._fit((x - self.mean) / self.scale, y, class_weights(labels, sizes))

    def cache(self) -> Remembered:
        other, shapes, ids = self.shapes[b"\x02other"], self.shapes, self.ids
        return Remembered(lambda w: ids[w] if w in ids else shapes.get(shape(w), other), HELD)

    def encode(self, words: list[bytes], cache: Remembered | None = None) -> np.ndarray:
        """Places of the words' vectors; a word that repeats the one before has a place of its own."""
        cache = self.cache() if cache is None else cache
        out = np.array(list(map(cache.__getitem__, words)), np.int64)
        if len(out) > 1:
            out[1:][np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1)] = self.shapes[b"\x02same"]
        return out

    def _learn(self, texts: list[np.ndarray], base: np.ndarray) -> np.ndarray:
        """A word's vector: its own index vector, and those of its neighbours damped by how common they are."""
        total = np.zeros_like(base, np.float64)
        seen = np.bincount(np.concatenate(texts), minlength=len(base)) if texts else np.zeros(len(base))
        damp = (1 / np.sqrt(1.0 + seen)).astype(np.float32)[:, None] * base
        for ids in texts:
            for o in range(1, SPAN + 1):
                for a, b in ((ids[:-o], ids[o:]), (ids[o:], ids[:-o])):
                    if len(a):
                        order = np.argsort(a, kind="stable")
                        heads, at = np.unique(a[order], return_index=True)
                        total[heads] += np.add.reduceat(damp[b[order]], at, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return (base / np.sqrt(NONZERO) + total / np.where(norm > 0, norm, 1)).astype(np.float32)

    def pool(self, words: list[bytes], cache: Remembered | None = None) -> np.ndarray:
        ids = self.encode(words, cache)
        extra = sum((index_vector(p) for p in profile(words)), np.zeros(DIM, np.float32))
        if not len(ids):
            return np.concatenate([np.zeros(DIM), extra])
        seen, n = np.unique(ids, return_counts=True)
        return np.concatenate([(n[:, None] * self.vectors[seen]).sum(axis=0) / len(ids), extra])

    def _fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Adam on the weighted loss over four fifths; the temperature and offset on the rest."""
        rng = np.random.default_rng(9)
        rest = np.arange(len(y)) % 5 == 4
        if len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
            rest[:] = False
        a, b, wa = x[~rest], y[~rest], w[~rest]
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(b)), max(1, len(b) // 256)):
                step += 1
                h = np.tanh(a[part] @ p[0] + p[1])
                g = wa[part] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b[part]) / len(part)
                back = np.outer(g, p[2]) * (1 - h * h)
                for k, d in enumerate((a[part].T @ back + 2e-3 * p[0], back.sum(axis=0), h.T @ g + 2e-3 * p[2], np.array([g.sum()]))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.net = p
        logits, t, wt = self.logits(x[rest] if rest.any() else x, scaled=True), y[rest] if rest.any() else y, w[rest] if rest.any() else w
        loss = lambda k: float((wt * (np.logaddexp(0, logits / k) - t * logits / k)).sum())
        self.temperature = min(np.geomspace(0.3, 10, 60).tolist(), key=loss)

    def logits(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else (x - self.mean) / self.scale
        return np.tanh(x @ self.net[0] + self.net[1]) @ self.net[2] + self.net[3]

    def scores(self, texts: list[bytes], cache: Remembered | None = None) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        cache = self.cache() if cache is None else cache
        x = np.stack([self.pool(t.split(), cache) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score; a row for each row of docs.

    The model is fitted on a bounded sample of labelled rows (sampling.PER_CLASS of each class, of MAX_CHARS at most),
    never on held-out ones, and then scores every whole text. Without labels of both classes the score is the share
    of class 1 (0 without any).

    Null text: empty, scored by its length pseudo-word. Null doc_id: not held out, not learned from. Repeated rows
    each get a row. Only doc_id and text are read, and doc_id and quality of labels. Empty table: no rows.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(*labelled_sample(docs, labels, "quality")))  # VOCABULARY bounds it

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.value.cache()
        for batch in pieces(batches):
            s = model.value.scores([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    asked = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), docs["text"].cast("string").alias("text"))
    return asked.mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
