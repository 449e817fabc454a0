"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by a benchmark item when some stretch of it turns into the item with
at most ``floor((1 - similarity) * words)`` word edits (insertions, deletions, substitutions).
Words are compared lower-cased, with ASCII punctuation, Unicode punctuation and white space as
separators. Each letter of a script written without spaces (Han, kana, Thai, Khmer ...) is a word, with
the marks on it.

For each item-sized window of a document (as many words as the item has):

1. The window is embedded by the random walk of Chakraborty, Goldenberg and Koucky: step j writes
   the current word and moves on by a random bit that depends on j and that word. Two sequences
   that are close in edit distance walk back into step, so their outputs are close in Hamming
   distance. Each of ``repetitions`` uses its own random bits.
2. Each repetition samples ``sampled`` coordinates of the first 1.5n steps (a walk takes about 2n to
   end; for items under ``SURE`` words the first n, in which none can end); windows that agree with an
   item on all of them in any repetition are candidates (repeated bit-sampling LSH). A coordinate at
   which a walk has ended agrees with nothing.
3. Candidates are verified by the exact edit distance between the item and the best stretch
   around the window.

Windows that cannot match are skipped without loss: an item of n words cut into e + 1 pieces has
at least one piece untouched by e edits, so only windows laid by an untouched piece at its place
are embedded. What is found depends on the LSH alone; ``tests/llm`` measures its recall.

The benchmark is taken in blocks of at most ``block_words`` words, each broadcast in turn and
held against all documents, so its size is bounded whatever the benchmark's. Documents are read
once per block, in Arrow batches, without any shuffle.

Items of fewer than ``min_words`` words are found where all their words stand unedited (at a similarity
of 0.8 no edit is allowed to them anyway); null, empty and other items without a word match nothing. Null
and empty texts match nothing. Items without item_id have nothing to report but take part in ``drop_leaks``.
Repeated items each report, repeated rows of a document are each judged. Empty tables give empty results. Other columns are carried where
documents are returned.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_pieces, small_batches

#: Bytes that separate words: ASCII other than letters and digits.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


#: Scripts written without spaces.
UNSPACED = ((0xE01, 0xE5B), (0xE81, 0xEDF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAD), (0x3005, 0x3007),
            (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF),
            (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Separators other than ASCII, and letters of unspaced scripts with their marks."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(128, 0x20000)}
    apart = {c for c, k in kind.items() if k in "PZ" or chr(c).isspace()}
    own = [c for a, b in UNSPACED[:-1] for c in range(a, b + 1) if c not in apart]
    some = lambda codes: "".join(re.escape(chr(c)) for c in codes)
    letter = some(c for c in own if kind[c] != "M") + chr(UNSPACED[-1][0]) + "-" + chr(UNSPACED[-1][1])
    return re.compile(f"[{some(sorted(apart))}]"), re.compile(f"[{letter}][{some(c for c in own if kind[c] == 'M')}]*")


def normal(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii():
        apart, letter = _patterns()
        distinct = "".join(set(text))
        for c in apart.findall(distinct):
            text = text.replace(c, " ")
        if letter.search(distinct):
            text = letter.sub(r" \g<0> ", text)
    return text.encode().translate(TO_SPACE)


#: Items of fewer words sample only steps that no walk can have ended before.
SURE = 8


class _Vocabulary(dict):
    """Word -> symbol from 1; other words are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all values of the ranges lo[i] .. hi[i] - 1."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[owner]


class Index:
    """One block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, min_words: int,
                 repetitions: int, sampled: int, seed: int):
        words = [(i, normal(t).split()) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.item_ids = [i for i, _ in words]
        self.symbol = _Vocabulary()
        for _, w in words:
            for x in w:
                self.symbol.setdefault(x, len(self.symbol) + 1)
        self.n = np.array([len(w) for _, w in words], np.int64)
        self.edits = np.where(self.n < min_words, 0, np.floor((1 - similarity) * self.n + 1e-9)).astype(np.int64)
        self.widest = int(self.n.max()) if words else 0
        self.sequences = np.zeros((len(words), self.widest), np.int64)
        for k, (_, w) in enumerate(words):
            self.sequences[k, :len(w)] = [self.symbol[x] for x in w]
        rng = np.random.default_rng(seed)
        odd = lambda *shape: rng.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
        self.hash = odd(len(self.symbol) + 1)
        self.step = odd(3 * self.widest, repetitions)
        self.sample = np.sort(rng.random((repetitions, sampled)), axis=1)
        self.mix = odd(sampled + 1)
        self.ended = odd(2)  # what an ended walk writes: one for items, one for windows
        self.gram = odd(self.widest + 1)
        # the pieces of which one survives any allowed edits: key -> item and offset, by length
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k in range(len(words)):
            q = int(self.n[k] // (self.edits[k] + 1))
            for o in range(0, q * int(self.edits[k] + 1), q):
                pieces.setdefault(q, []).append((int(self._grams(self.sequences[k, o:o + q], q)[0]), k, o))
        self.pieces = {}
        for q, p in pieces.items():
            key, item, offset = zip(*sorted(p))
            self.pieces[q] = np.array(key, np.uint64), np.array(item), np.array(offset)
        keys = self.embed(self.sequences, self.n, 0) if words else np.zeros((repetitions, 0), np.uint64)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def _grams(self, symbols: np.ndarray, q: int) -> np.ndarray:
        """A key of each run of ``q`` symbols."""
        h, n = self.hash[symbols], len(symbols) - q + 1
        return sum((h[i:n + i] * self.gram[i] for i in range(1, q)), h[:n] * self.gram[0])

    def embed(self, windows: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
        """Keys (repetition, window) of the sampled coordinates of the walks over ``windows`` (side 1) or items (side 0)."""
        rows = np.arange(len(n))
        at = np.zeros((len(self.sample), len(n)), np.int64)
        wanted = (self.sample[:, :, None] * np.where(n < SURE, n, 1.5 * n)).astype(np.int64)  # repetition, sample, window
        key = np.broadcast_to(n.astype(np.uint64) * self.mix[-1], at.shape).copy()
        seen = self.hash[windows]
        for j in range(int(wanted.max()) + 1 if n.size else 0):
            ended = at >= n
            h = np.where(ended, np.uint64(0), seen[rows, np.minimum(at, n - 1)])
            for s in range(self.sample.shape[1]):
                hit = wanted[:, s] == j
                if hit.any():
                    key += np.where(hit, np.where(ended, self.ended[side], h) * self.mix[s] + np.uint64(s), np.uint64(0))
            at += ((h * self.step[j][:, None]) >> np.uint64(63)).astype(np.int64)
        return key

    def windows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, words) of the windows laid by surviving pieces."""
        found = []
        for q, (keys, item, offset) in self.pieces.items():
            known = symbols > 0
            run = known[:len(symbols) - q + 1].copy()
            for i in range(1, q):
                run &= known[i:len(symbols) - q + 1 + i]
            places = np.flatnonzero(run)
            if not places.size:
                continue
            grams = self.hash[symbols[places]] * self.gram[0]
            for i in range(1, q):
                grams += self.hash[symbols[places + i]] * self.gram[i]
            owner, k = _ranges(np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right"))
            found.append(np.stack([places[owner] - offset[k], self.n[item[k]]]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, n = np.unique(np.concatenate(found, axis=1), axis=1)
        return start, n

    def candidates(self, symbols: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, item) for which some repetition agrees."""
        places = start[:, None] + np.arange(self.widest)
        inside = (places >= 0) & (places < len(symbols)) & (np.arange(self.widest) < n[:, None])
        windows = np.where(inside, symbols[np.clip(places, 0, len(symbols) - 1)], 0)
        found = []
        for keys, known, order in zip(self.embed(windows, n, 1), self.keys, self.order):
            owner, k = _ranges(np.searchsorted(known, keys), np.searchsorted(known, keys, "right"))
            found.append(np.stack([start[owner], order[k]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def distances(self, symbols: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Least word edits between the item and any stretch around the window at ``start``."""
        reach = self.edits[item]
        width = int((self.n[item] + 2 * reach).max())
        places = (start - reach)[:, None] + np.arange(width)
        inside = (places >= 0) & (places < len(symbols)) & (np.arange(width) < (self.n[item] + 2 * reach)[:, None])
        text = np.where(inside, symbols[np.clip(places, 0, len(symbols) - 1)], 0)
        ramp = np.arange(width + 1)
        cost = np.zeros((len(item), width + 1), np.int64)
        out = np.zeros(len(item), np.int64)
        for i in range(int(self.n[item].max())):
            change = cost[:, :-1] + (text != self.sequences[item, i][:, None])
            now = cost + 1
            now[:, 1:] = np.minimum(now[:, 1:], change)
            cost = np.minimum.accumulate(now - ramp, axis=1) + ramp
            ended = self.n[item] == i + 1
            out[ended] = cost[ended].min(axis=1)
        return out

    def symbols(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.symbol.__getitem__, w), np.int64, len(w))
                 for w in map(bytes.split, byte_pieces(normal(text)))]
        return np.concatenate(parts)

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, item, edits, first word of the window) of each text and item found."""
        if not self.item_ids:
            return
        own = [self.symbols(t) for t in texts]
        gap = np.zeros(2 * self.widest, np.int64)  # no window or stretch reaches another text's words
        symbols = np.concatenate([x for s in own for x in (s, gap)] or [gap])
        first = np.cumsum([0, *(len(s) + len(gap) for s in own)])
        start, n = self.windows(symbols)
        step = max(1, (1 << 24) // (len(self.sample) * self.widest))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k in range(0, len(start), step):
            at, item = self.candidates(symbols, start[k:k + step], n[k:k + step])
            for m in range(0, len(at), step):
                a, b = at[m:m + step], item[m:m + step]
                d = self.distances(symbols, a, b)
                doc = np.searchsorted(first, a + self.n[b] // 2, "right") - 1
                for i in np.flatnonzero(d <= self.edits[b]):
                    key, value = (int(doc[i]), int(b[i])), (int(d[i]), int(max(0, a[i] - first[doc[i]])))
                    best[key] = min(value, best.get(key, value))
        for (doc, item), (d, at) in sorted(best.items()):
            yield doc, item, d, at


@lru_cache(maxsize=4)
def _index(spec: str) -> Index:
    return Index(*json.loads(spec))


def _blocks(items: DataFrame, block_words: int, *options) -> Iterator:
    """Broadcasts of the benchmark's blocks (item_id, text), each of about ``block_words`` words; equal rows once."""
    sized = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    words = sized.agg(F.sum(F.octet_length("text") / 4)).first()[0] or 0
    n = int(words // block_words) + 1
    for b in range(n):
        block = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield items.sparkSession.sparkContext.broadcast(json.dumps([[tuple(r) for r in block], *options]))


OPTIONS = {"similarity": 0.8, "min_words": 5, "repetitions": 128, "sampled": 4, "seed": 7}


def find_leaks(docs: DataFrame, items: DataFrame, block_words: int = 200_000, **options) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word): each document and item found in it."""
    small_batches(docs.sparkSession)
    given = {**OPTIONS, **options}
    items, out = items.filter(F.col("item_id").isNotNull()), None
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, item_words int, first_word long"
    for spec in _blocks(items, block_words, *given.values()):
        def run(batches: Iterator[pa.RecordBatch], spec=spec) -> Iterator[pa.RecordBatch]:
            index = _index(spec.value)
            for b in batches:
                hits = list(index.hits(b.column("text").to_pylist()))
                rows = [[x[k] for x in hits] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array([index.item_ids[i] for i in rows[1]], pa.int64()),
                     pa.array(rows[2], pa.int32()), pa.array([int(index.n[i]) for i in rows[1]], pa.int32()),
                     pa.array(rows[3], pa.int64())], ["doc_id", "item_id", "edits", "item_words", "first_word"])
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, block_words: int = 200_000, **options) -> DataFrame:
    """``docs`` without the documents in which any item is found, with or without an item_id."""
    small_batches(docs.sparkSession)
    given = {**OPTIONS, **options}
    items = items.select(F.lit(None).cast("long").alias("item_id"), "text")
    for spec in _blocks(items, block_words, *given.values()):
        def run(batches: Iterator[pa.RecordBatch], spec=spec) -> Iterator[pa.RecordBatch]:
            index = _index(spec.value)
            for b in batches:
                bad = {x[0] for x in index.hits(b.column("text").to_pylist())}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b
        docs = docs.mapInArrow(run, docs.schema)
    return docs
