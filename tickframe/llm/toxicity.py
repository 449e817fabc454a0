"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words (A-Z and other letters lower-cased); a word is the bag of its
character n-grams with end marks and of itself, hashed into ``buckets``. Each bucket has a vector
of ``dim`` numbers; a text's vector is the mean over all its subwords, and a linear softmax over
it gives the class. Vectors and softmax weights are trained together, so a misspelled or unseen
word scores through the n-grams that it shares with words seen in training.

Training uses a bounded sample of labelled texts, at most ``per_class`` of each class (those of
the least hash of doc_id) of at most ``train_bytes`` bytes. Tasks turn them into bags and the
driver fits with mini-batch Adam; subwords of fewer than ``min_texts`` sampled texts get no
vector, as they would only memorise those texts. A sixth of the sample is left out of the fit and
calibrates the scores (a line through the logit), weighted back to the labels' shares.

Scoring reads every text once. Mean and softmax are linear, so a subword's part in the difference
of the two logits is one number, and a word's sums are kept in a bounded cache of the worker.

Null and empty texts have no subwords and score the bias alone. Repeated rows are scored each.
Without labels of both classes every score is the share of toxic labels (0 without any). An empty
table gives an empty result. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_pieces, small_batches

#: Runs of letters, digits, symbols that stand in for letters, and bytes beyond ASCII.
WORDS = re.compile(rb"[0-9a-z@$*_\x80-\xff]+").findall
OPTIONS = {"buckets": 1 << 20, "dim": 8, "shortest": 3, "longest": 6, "per_class": 1500, "train_bytes": 200_000, "min_texts": 5,
           "updates": 1000, "rate": 0.02, "decay": 1e-4, "seed": 5}
#: A mean over hundreds of subwords is small; the softmax sees it enlarged.
SCALE = 100.0
CACHED, CACHED_BYTES = 400_000, 48


def subwords(word: bytes, buckets: int, shortest: int, longest: int) -> list[int]:
    """Buckets of the word between end marks and of its character n-grams."""
    chars = (b"<" + word + b">").decode("utf-8", "replace")
    n = len(chars)
    return [crc32(chars.encode()) % buckets, *(crc32(chars[i:i + k].encode()) % buckets
                                                for k in range(shortest, min(longest, n - 1) + 1) for i in range(n - k + 1))]


def words_of(text: str | None) -> Iterator[list[bytes]]:
    for piece in byte_pieces((text or "").lower().encode()):
        yield WORDS(piece)


def bag(text: str | None, buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subword buckets of a text and their shares (they add up to 1)."""
    counts = Counter()
    for words in words_of(text):
        counts.update(words)
    found = [(subwords(w, buckets, shortest, longest), n) for w, n in counts.items()]
    every = np.concatenate([np.array(g, np.int64) for g, _ in found] or [np.empty(0, np.int64)])
    times = np.repeat([float(n) for _, n in found], [len(g) for g, _ in found])
    at, of = np.unique(every, return_inverse=True)
    return at, np.bincount(of, times, len(at)) / max(1.0, times.sum())


class Model:
    """Subword vectors E (subwords, dim) and a softmax over two classes with bias.

    With two classes only the difference of the softmax's columns, ``d`` and ``b``, decides.
    """

    def __init__(self, subwords: int, dim: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.E = self.rng.normal(0, 0.1, (subwords, dim)).astype(np.float32)
        self.d = self.rng.normal(0, 0.1, dim)
        self.b = np.zeros(1)

    def logits(self, bags: list) -> np.ndarray:
        s = self.E @ self.d * SCALE
        return np.array([share @ s[at] for at, share in bags]) + self.b[0]

    def fit(self, bags: list, y: np.ndarray, updates: int, rate: float, decay: float, batch: int = 64) -> None:
        """Adam on the cross-entropy, both classes weighing the same; the rate falls to zero over the updates."""
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.E, self.d, self.b)]
        order = np.empty(0, np.int64)
        for t in range(1, updates + 1):
            if not order.size:
                order = self.rng.permutation(len(y))
            some, order = order[:batch], order[batch:]
            at = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some]) * SCALE
            text = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            z = np.bincount(text, share * (self.E @ self.d)[at], len(some)) + self.b[0]
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[some]) * weight[some] / len(some)
            G = np.bincount(at, share * g[text], len(self.E)).astype(np.float32)
            grads = (np.outer(G, self.d.astype(np.float32)) + np.float32(decay) * self.E, self.E.T @ G, g.sum(keepdims=True))
            now = rate * (1 - t / updates) / (1 - 0.9 ** t)
            for x, dx, (m, v) in zip((self.E, self.d, self.b), grads, state):
                m += 0.1 * (dx - m)
                v += 0.001 * (dx * dx - v)
                x -= now * m / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


def calibration(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, shift) of the logistic line through logits ``z``, classes weighted to ``share`` of ones."""
    if len(set(y)) < 2:
        return 1.0, math.log(share / (1 - share))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y).mean()) / len(y)
    mid, wide = z.mean(), max(z.std(), 1e-9)
    X, w = np.stack([(z - mid) / wide, np.ones_like(z)], 1), np.array([1.0, math.log(share / (1 - share))])
    for _ in range(50):  # Newton steps, held near the start by a small ridge
        p = 1 / (1 + np.exp(-np.clip(X @ w, -50, 50)))
        w -= np.clip(np.linalg.solve(X.T @ (X * (p * (1 - p) * weight)[:, None]) + 1e-3 * np.eye(2), X.T @ ((p - y) * weight)), -1, 1)
    slope = max(float(w[0]), 1e-3) / wide
    return slope, float(w[1] - slope * mid)


def train(docs: DataFrame, labels: DataFrame, **options) -> tuple[np.ndarray, float]:
    """(parts, bias) of a model fitted to the labelled documents (doc_id, toxic): the logit of a
    text is the bias plus the mean of its subwords' parts."""
    o = {**OPTIONS, **options}
    small_batches(docs.sparkSession)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        prior = 0.0 if 1 not in totals else 1.0
        return np.zeros(o["buckets"]), 40.0 if prior else -40.0
    chosen = {}
    for y in (0, 1):
        rows = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(o["per_class"]).collect()
        chosen |= {r.doc_id: y for r in rows}
    spread = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.coalesce(pa.compute.binary_length(b.column("text")), pa.scalar(0, pa.int32())).to_pylist()
            ids = [i for i, d in enumerate(b.column("doc_id").to_pylist()) if d in spread.value and size[i] <= o["train_bytes"]]
            part = b.take(pa.array(ids, pa.int64()))
            bags = [bag(t, o["buckets"], o["shortest"], o["longest"]) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([a.astype("<u4").tobytes() for a, _ in bags], pa.binary()),
                                              pa.array([s.astype("<f4").tobytes() for _, s in bags], pa.binary())], ["doc_id", "at", "share"])

    bags = {}
    packed = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, at binary, share binary")
    # of the rows of one doc_id always the same one, picked before anything comes to the driver
    one = packed.groupBy("doc_id").agg(F.min(F.struct("at", "share")).alias("bag")).select("doc_id", "bag.at", "bag.share")
    for b in one.toArrow().to_batches():
        bags |= {doc_id: (a, s) for doc_id, a, s in zip(*(c.to_pylist() for c in b.columns))}
    order = sorted(bags, key=lambda d: crc32(b"%d" % d))
    y = np.array([chosen[d] for d in order], float)
    share = totals[1] / (totals[0] + totals[1])
    if len(set(y)) < 2:
        return np.zeros(o["buckets"]), math.log(share / (1 - share))
    bags = [(np.frombuffer(a, "<u4"), np.frombuffer(s, "<f4")) for a, s in (bags.pop(d) for d in order)]
    texts = np.zeros(o["buckets"], np.int64)
    for a, _ in bags:
        texts[a] += 1
    used = np.flatnonzero(texts >= min(o["min_texts"], max(1, len(y) // 10)))
    place = np.full(o["buckets"], -1, np.int32)
    place[used] = np.arange(len(used))
    for i, (a, s) in enumerate(bags):
        known = place[a] >= 0
        bags[i] = place[a[known]], s[known]
    left_out = np.arange(len(y)) % 6 == 0
    model = Model(len(used), o["dim"], o["seed"])
    model.fit([bags[i] for i in np.flatnonzero(~left_out)], y[~left_out], o["updates"], o["rate"], o["decay"])
    slope, shift = calibration(model.logits([bags[i] for i in np.flatnonzero(left_out)]), y[left_out], share)
    parts = np.zeros(o["buckets"])
    parts[used] = model.E @ model.d * SCALE * slope
    return parts, slope * float(model.b[0]) + shift


class _WordSums(dict):
    """word -> sum of its subwords' parts + 1j * their number."""

    def __init__(self, parts: np.ndarray, shortest: int, longest: int):
        self.parts, self.sizes = parts, (shortest, longest)

    def __missing__(self, word: bytes) -> complex:
        at = subwords(word, len(self.parts), *self.sizes)
        value = complex(float(self.parts[at].sum()), len(at))
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = value
        return value


def scores(docs: DataFrame, model: tuple[np.ndarray, float], **options) -> DataFrame:
    """(doc_id, score): the probability of the toxic class for every document."""
    o = {**OPTIONS, **options}
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((model[0].astype("f4"), model[1]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bias = spread.value
        table = _WordSums(parts, o["shortest"], o["longest"])
        for b in batches:
            z = []
            for text in b.column("text").to_pylist():
                total = sum((sum(map(table.__getitem__, w)) for w in words_of(text)), 0j)
                z.append(bias + (total.real / total.imag if total.imag else 0.0))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the labels outside the held-out fold."""
    model = train(docs, labels.filter(~held_out()), **options)
    return scores(docs, model, **options).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
