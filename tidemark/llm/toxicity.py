"""Toxicity: a linear-chain CRF marks toxic tokens; its marginals add up to a score and offending offsets."""

from __future__ import annotations

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

THRESHOLD = 0.3
SUFFIXES = 2048
EPOCHS, RATE = 40, 0.1
#: Longest text that the chain is trained on.
MAX_CHARS = 6000
LEAST_DOCS, LEAST_GAIN, LEAST_LIFT, MOST_OFTEN = 3, 18.0, 8.0, 3
#: Beginnings of words that stand for them beside the words: toxic words come in many inflections.
STEMS = (4, 5)
NEAR = 200
HELD = 200_000
BLOCK = 64
_EDGES = bytes(c for c in range(128) if not chr(c).isalnum())


def core(word: bytes) -> bytes:
    """The word without ASCII marks at its ends, A-Z lower-cased."""
    return word.strip(_EDGES).lower()


def units(x: bytes) -> list[bytes]:
    """A word and its beginnings, whole characters, each marked by its length."""
    c = x.decode(errors="ignore")
    return [x, *[b"\x00%d" % n + c[:n].encode() for n in STEMS if len(c) >= n]]


def _vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows v[t] = v[t-1] [[a, b], [c, d]][t], each scaled to sum 1, from any start; work in proportion to their number.

    Products of whole blocks give the vectors at the blocks' ends (by the same means, a level up); all blocks then run
    side by side.
    """
    n = len(a)
    if n <= BLOCK:
        out, x, y = np.empty((n, 2)), 0.5, 0.5
        for t, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
            x, y = x * p + y * r, x * q + y * s
            z = x + y
            x, y = x / z, y / z
            out[t] = x, y
        return out
    k = -(-n // BLOCK)
    a, b, c, d = (np.ascontiguousarray(np.concatenate([m, np.full(k * BLOCK - n, one)]).reshape(k, BLOCK).T) for m, one in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, BLOCK):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        z = 1.0 / (p + q + r + s)
        p, q, r, s = p * z, q * z, r * z, s * z
    ends = _vectors(p, q, r, s)
    x, y = np.concatenate([[0.5], ends[:-1, 0]]), np.concatenate([[0.5], ends[:-1, 1]])
    out = np.empty((BLOCK, k, 2))
    for t in range(BLOCK):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        z = 1.0 / (x + y)
        x, y = x * z, y * z
        out[t, :, 0], out[t, :, 1] = x, y
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over many texts end to end: P(tag 1) of each token, and sums of P(tags) of neighbours.

    emit: log weight of tag 1 against 0; first: whether the token begins a text; trans, start: log weights.
    A text's first matrix forgets what came before, so texts do not touch.
    """
    e = np.clip(emit, -40, 40)
    zero, one = np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))
    t, s = np.exp(trans), np.exp(start)
    a, b = np.where(first, s[0], t[0, 0]) * zero, np.where(first, s[1], t[0, 1]) * one
    c, d = np.where(first, s[0], t[1, 0]) * zero, np.where(first, s[1], t[1, 1]) * one
    f = _vectors(a, b, c, d)
    last = np.append(first[1:], True)
    after = lambda x: np.where(last, 1.0, np.append(x[1:], 1.0))[::-1]  # noqa: E731  what follows a token, from the end on
    back = _vectors(after(a), after(c), after(b), after(d))[::-1]
    p = f * back
    hot = p[:, 1] / p.sum(axis=1)
    if not pairs:
        return hot, None
    k = np.flatnonzero(~first)
    x = np.stack([f[k - 1, 0] * a[k] * back[k, 0], f[k - 1, 0] * b[k] * back[k, 1], f[k - 1, 1] * c[k] * back[k, 0], f[k - 1, 1] * d[k] * back[k, 1]])
    return hot, (x / x.sum(axis=0)).sum(axis=1).reshape(2, 2)


def apart(texts: list[list[bytes]]) -> np.ndarray:
    """False for texts that near copy an earlier one: it has seen two of the four least hashes of their word triples."""
    seen: set[int] = set()
    out = np.ones(len(texts), bool)
    for i, ws in enumerate(texts):
        least = sorted({zlib.crc32(b" ".join(ws[k : k + 3])) for k in range(max(1, len(ws) - 2))})[:4]
        out[i] = sum(x in seen for x in least) < min(2, len(least))
        seen.update(least)
    return out


def toxic_words(texts: list[Counter], lengths: np.ndarray, labels: np.ndarray, w: np.ndarray) -> set[bytes]:
    """Units far more frequent in toxic texts: in LEAST_DOCS of them, by lift and by likelihood-ratio gain.

    A text counts a unit MOST_OFTEN times at most, so that no single one makes a unit toxic; what is compared is
    occurrences a token, so that long clean texts which hold a unit by chance don't clear it. The gain asked for grows
    with the number of units looked at, so that chance finds none.
    """
    bad, good, docs = Counter(), Counter(), Counter()
    for units_, y, k in zip(texts, labels, w, strict=True):
        capped = {x: min(n, MOST_OFTEN) for x, n in units_.items()}
        if y:
            bad.update(capped)
            docs.update(units_.keys())
        else:
            for x, n in capped.items():
                good[x] += n * k
    looked = [x for x, d in docs.items() if d >= LEAST_DOCS]
    least = max(LEAST_GAIN, 2 * np.log(max(1, len(looked))))
    n1, n0 = max(1.0, float(lengths[labels == 1].sum())), max(1.0, float(lengths[labels == 0].sum()))
    scale, out = w[labels == 0].mean() if (labels == 0).any() else 1.0, set()
    for x in looked:
        k1, k0 = bad[x], good[x] / scale
        if (k1 + 0.5) / n1 < LEAST_LIFT * (k0 + 0.5) / n0:
            continue
        rate = (k1 + k0) / (n1 + n0)
        part = lambda k, n: k * np.log(max(k, 1e-12) / (n * rate))
        if 2 * (part(k1, n1) + part(k0, n0)) >= least:
            out.add(x)
    return out


class Tagger:
    """Weights of words, of suffixes and of tag pairs; then a logistic step from marginals to a document's score."""

    def __init__(self, texts: list[bytes], labels: list[int], sizes: dict[int, int]):
        self.prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
        self.words: dict[bytes, int] | None = None
        y = np.array(labels)
        if len(set(labels)) < 2:
            return
        split = [[core(x) for x in t.split()] for t in texts]
        made: dict[bytes, list[bytes]] = {x: units(x) for s in split for x in s}
        counts = [Counter(u for x in s for u in made[x]) for s in split]
        own = np.flatnonzero(apart(split))  # copies of one toxic text must not make its words toxic
        bad = toxic_words([counts[i] for i in own.tolist()], np.array([len(split[i]) for i in own.tolist()]), y[own], class_weights(labels, sizes)[own])
        hot = {x for x, us in made.items() if any(u in bad for u in us)}
        seen = Counter(u for s in split for x in s for u in made[x])
        self.words = {u: i for i, u in enumerate(sorted(u for u, n in seen.items() if n >= 3 or u in bad))}
        rows = {x: [*self.features(x), self.suffix(x)] for x in made}
        flat = np.array([rows[x] for s in split for x in s], np.int64).reshape(-1, 2 + len(STEMS))
        ids, suf = flat[:, :-1], flat[:, -1]
        tags = np.array([float(t == 1 and x in hot) for s, t in zip(split, y, strict=True) for x in s])
        first = np.zeros(len(ids), bool)
        lens = np.array([len(s) for s in split])
        first[np.concatenate([[0], np.cumsum(lens[lens > 0])[:-1]]).astype(int)] = True
        self._fit(ids, suf, tags, first)
        self._score_step([self.tag(t)[0] for t in texts], y, class_weights(labels, sizes))

    @staticmethod
    def suffix(x: bytes) -> int:
        return zlib.crc32(x[-3:]) % SUFFIXES

    def features(self, x: bytes) -> list[int]:
        """Places of the word's units; one the vocabulary lacks has the last place, whose weight stays zero."""
        got = [self.words.get(u, len(self.words)) for u in units(x)]
        return got + [len(self.words)] * (1 + len(STEMS) - len(got))

    def _fit(self, ids, suf, tags, first) -> None:
        """Adagrad on the chain's log likelihood: counts of features in the tags less those the model expects."""
        nw = len(self.words)
        w, s = np.zeros(nw + 1), np.zeros(SUFFIXES)
        trans, start, bias = np.zeros((2, 2)), np.zeros(2), np.array([-3.0])
        g2 = [np.full_like(x, 1e-6) for x in (w, s, trans, start, bias)]
        was = np.concatenate([[0], tags[:-1]]).astype(int)
        now = tags.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (was[~first], now[~first]), 1)
        begun = np.bincount(now[first], minlength=2)
        word_n, suf_n = np.bincount(ids.ravel(), minlength=nw + 1), np.bincount(suf, minlength=SUFFIXES)
        for _ in range(EPOCHS):
            p, pair = marginals(w[ids].sum(axis=1) + s[suf] + bias[0], first, trans, start, pairs=True)
            miss = tags - p
            grads = (
                np.bincount(ids.ravel(), np.repeat(miss, ids.shape[1]), nw + 1) / np.sqrt(1 + word_n) - 0.02 * w,
                np.bincount(suf, miss, SUFFIXES) / np.sqrt(1 + suf_n) - 0.05 * s,
                (seen - pair) / np.sqrt(len(tags)) - 0.01 * trans,
                (begun - np.array([(1 - p[first]).sum(), p[first].sum()])) / np.sqrt(1 + first.sum()) - 0.01 * start,
                np.array([miss.sum()]) / np.sqrt(len(tags)) - 0.001 * bias,
            )
            for x, g, q, rate in zip((w, s, trans, start, bias), grads, g2, (6 * RATE, RATE, RATE, RATE, 2 * RATE), strict=True):
                q += g * g
                x += rate * g / np.sqrt(q)
            w[nw] = 0.0
        self.w, self.s, self.bias, self.trans, self.start = w, s, float(bias[0]), trans, start

    def emission(self, x: bytes) -> float:
        return float(self.w[self.features(x)].sum() + self.s[self.suffix(x)] + self.bias)

    def cache(self) -> Remembered:
        return Remembered(lambda x: self.emission(core(x)), HELD)

    def tag(self, text: bytes, cache: Remembered | None = None) -> tuple[np.ndarray, list[bytes]]:
        return self.tag_all([text], cache)[0]

    def tag_all(self, texts: list[bytes], cache: Remembered | None = None) -> list[tuple[np.ndarray, list[bytes]]]:
        cache = self.cache() if cache is None else cache
        split = [t.split() for t in texts]
        some = [s for s in split if s]
        if not some:
            return [(np.zeros(0), s) for s in split]
        emit = np.concatenate([np.array(list(map(cache.__getitem__, s))) for s in some])
        ends = np.cumsum([len(s) for s in some])
        first = np.zeros(len(emit), bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        parts = iter(np.split(marginals(emit, first, self.trans, self.start)[0], ends[:-1]))
        return [(next(parts) if s else np.zeros(0), s) for s in split]

    @staticmethod
    def evidence(m: np.ndarray) -> list[float]:
        """Of the marginals: their greatest sum over NEAR tokens in a row, their greatest, their mean. A long text gathers none by its length."""
        sums = np.concatenate([[0.0], np.cumsum(m)])
        near = float((sums[NEAR:] - sums[:-NEAR]).max()) if len(m) > NEAR else float(sums[-1])
        return [1.0, float(np.log1p(near)), float(m.max(initial=0.0)), float(np.log1p(1000 * m.sum() / (len(m) + 20)))]

    def _score_step(self, tags: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> None:
        x, c = np.array([self.evidence(m) for m in tags]), np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (w * (y - p)) - 0.1 * c)
            c += step
            if np.abs(step).max() < 1e-6:
                break
        self.c = c

    def scores(self, texts: list[bytes], cache: Remembered | None = None) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        if self.words is None:
            return np.full(len(texts), self.prior), [[] for _ in texts]
        tagged = self.tag_all(texts, cache)
        x = np.array([self.evidence(m) for m, _ in tagged]).reshape(-1, 4)
        offsets = []
        for t, (m, words) in zip(texts, tagged, strict=True):
            hot, out, at, k = set(np.flatnonzero(m >= 0.5).tolist()), [], 0, 0
            if hot:
                for i, word in enumerate(words[: max(hot) + 1]):
                    j = t.index(word, at)
                    k += len(t[at:j].decode())
                    n = len(word.decode())
                    if i in hot:
                        out.append((k, k + n))
                    at, k = j + len(word), k + n
            offsets.append(out)
        return 1 / (1 + np.exp(-np.clip(x @ self.c, -30, 30))), offsets


#: Tokens that one forward-backward pass takes, about; a longer text is a pass of its own.
PASS_TOKENS = 200_000


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, offending (start:end in code points of tokens that are likelier toxic, comma-joined).

    Token labels come from document labels: in a toxic text, the words that toxic texts have far oftener. The chain is
    trained on a bounded sample of labelled rows (sampling.PER_CLASS of each class), never on held-out ones. Every
    whole text is tagged. Without labels of both classes the score is the share of class 1, without offsets.

    Null text: empty, scored without evidence. Null doc_id: not held out, not learned from. Repeated rows each get a
    row. Only doc_id and text are read, and doc_id and toxic of labels. Empty table: no rows.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Tagger(*labelled_sample(docs, labels, "toxic", max_chars=MAX_CHARS)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.value.cache()
        for batch in pieces(batches, 2048):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            score, offsets, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 6 * PASS_TOKENS):
                    size += len(texts[to])
                    to += 1
                s, o = model.value.scores(texts[at:to], cache)
                score += s.tolist()
                offsets += [",".join(f"{a}:{b}" for a, b in x) for x in o]
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(offsets, pa.string())], names=["doc_id", "held_out", "score", "offending"])

    asked = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), docs["text"].cast("string").alias("text"))
    return asked.mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, offending string")


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
