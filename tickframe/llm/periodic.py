"""Periodic runs of words: stretches that repeat with some period, found by scale tiles.

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal)
and a length of at least 2q and ``min_length``.

Method. For each octave of periods [P, 2P) a document is cut into overlapping tiles. A run of a
period p in the octave has a multiple of P between its start and its last word but p; around such
a boundary b two Z-functions (of what follows b, and of what precedes it, read backwards) give for
every p how far period p reaches to both sides within the tile. Tiles know nothing of each other.
The pieces that they report are shuffled by document and period and stitched where they overlap by
a period or more.

Two exact tests spare tiles. Matching stretches of a run hold ``min_length // 2`` words or more,
so all its positions see their next words again within p: a boundary is kept only next to a long
enough stretch of such positions. And a boundary whose whole window has one period below P can't
touch a run whose smallest period is P or more. Pieces whose period isn't the smallest go at once
(if a piece of two periods has a smaller one, so has its run).

Documents without tiles are finished in the first pass; of the others the words wait in a table in
the shared folder, next to the tiles. A document is never compared with another one, so groups of
copies cost their number only; each row has a key of its own, repeated and null ids included.
Null and empty texts have no words and no runs. An empty table gives an empty result. Other columns
than ``doc_id`` and ``text`` are not read. Very long texts are split into words piece by piece;
ties don't arise, as two runs of one period never start at the same word.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import byte_pieces, small_batches, staged

#: Words that a tile covers, its overlaps aside: so many boundaries, or so many words at least.
TILE_BOUNDARIES, TILE_WORDS = 8, 256
#: Rows of a batch that leaves a task.
ROWS = 512

Run = tuple[int, int, int]  # start, length, period
PIECE = "key long, period int, start long, stop long"


# --------------------------------------------------------------------------- words
def word_ids(raw: bytes) -> np.ndarray:
    """The words of a text as numbers, equal for equal words."""
    index: dict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) for words in (p.split() for p in byte_pieces(raw))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words: equal for equal words, and quicker than their numbers."""
    parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in (p.split() for p in byte_pieces(raw))]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).view(np.uint64)


def kept_words(raw: bytes, runs: list[Run], n: int) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def collapse(raw: bytes, runs: list[Run], n: int) -> Iterator[bytes]:
    """The words that stay, in pieces that are to be joined by one space."""
    keep, at = kept_words(raw, runs, n), 0
    for piece in byte_pieces(raw):
        words = piece.split()
        left = [w for w, k in zip(words, keep[at:at + len(words)].tolist()) if k] if runs else words
        at += len(words)
        if left:
            yield b" ".join(left)


# --------------------------------------------------------------------------- tiles
def window_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` words in a row, put together from those of powers of two."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    out, done, part, size = None, 0, x, 1
    while True:
        if k & size:
            m = len(x) - done - size + 1
            out = part[:m].copy() if out is None else out[:m] * odd + part[done:done + m]
            done += size
        if done == k:
            return out
        m = len(x) - 2 * size + 1
        part = part[:m] * (odd ^ np.uint64(size << 8)) + part[size:size + m]
        size *= 2


def next_same(x: np.ndarray, k: int) -> np.ndarray | None:
    """For each window of k words (given by hashes) the distance to the next equal one, else a huge
    number; None where no window comes twice.

    Different windows of one hash would at worst keep a tile that holds no run.
    """
    if len(x) <= k:
        return None
    h = window_hashes(x, k)
    ranked = np.sort(h)
    if not (ranked[1:] == ranked[:-1]).any():
        return None
    gap = np.full(len(h), np.iinfo(np.int64).max)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return gap


def boundaries(ids: np.ndarray, gap: np.ndarray, p: int, min_length: int, k: int) -> list[int]:
    """The multiples of ``p`` at which a run with a smallest period in [p, 2p) may be met."""
    n, near = len(ids), gap < 2 * p
    need = min(max(min_length - q, q) for q in (p, min(2 * p - 1, max(p, min_length // 2)))) - k + 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    long = last - first >= need
    if not long.any():
        return []
    mark = np.zeros(n // p + 3, np.int32)
    np.add.at(mark, -(-first[long] // p), 1)
    np.add.at(mark, np.minimum(last[long] - 1 + k, n - 1) // p + 1, -1)
    out = []
    for b in (np.flatnonzero(np.cumsum(mark) > 0) * p).tolist():
        lo, hi = max(0, b - 2 * p), min(n, b + 4 * p)
        d = int(gap[lo]) if lo < len(gap) else n
        if b + p <= n and not (d < p and np.array_equal(ids[lo:hi - d], ids[lo + d:hi])):
            out.append(b)
    return out


def tiles(raw: bytes, min_length: int = 12) -> tuple[int, Iterator[tuple[int, int, np.ndarray, list[int]]]]:
    """The number of words, and (P, first word, words, boundaries counted from the first word) of every tile that is needed."""
    x, k = word_hashes(raw), max(1, min_length // 2)
    gap = next_same(x, k)
    return len(x), iter(()) if gap is None else _cut(word_ids(raw), gap, min_length, k)


def _cut(ids: np.ndarray, gap: np.ndarray, min_length: int, k: int) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    n, p = len(ids), 1
    while 2 * p <= n:
        found = boundaries(ids, gap, p, min_length, k)
        wide, i = max(TILE_BOUNDARIES * p, TILE_WORDS), 0
        while i < len(found):
            j = i
            while j < len(found) and found[j] // wide == found[i] // wide:
                j += 1
            lo, hi = max(0, found[i] - 2 * p), min(n, found[j - 1] + 4 * p)
            yield p, lo, ids[lo:hi], [b - lo for b in found[i:j]]
            i = j
        p *= 2


def z_function(s: list[int], upto: int) -> list[int]:
    """For each i < upto how many elements from i on equal those from 0 on."""
    n = len(s)
    z = [0] * min(n, upto)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def stretch(ids: np.ndarray, q: int, start: int, stop: int) -> tuple[int, int]:
    """A piece of period q carried on to both sides as far as the tile goes."""
    ahead, behind = ids[stop:] != ids[stop - q:len(ids) - q], ids[:start] != ids[q:start + q]
    return (int(start - np.argmax(behind[::-1])) if behind.any() else 0), (int(stop + np.argmax(ahead)) if ahead.any() else len(ids))


def solve(p: int, ids: np.ndarray, bounds: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the pieces with smallest periods in [p, 2p) that the tile sees at its boundaries."""
    words, n, found, last = ids.tolist(), len(ids), [], {}
    for b in bounds:
        lo, hi, end = max(0, b - 2 * p), min(n, b + 4 * p), min(n, b + 2 * p)
        ahead = z_function(words[b:hi], 2 * p)
        ahead.append(0)
        before = words[lo:b][::-1]
        behind = z_function(before + [-1] + words[lo:end][::-1], len(before) + 2 + max(0, end - b - p))
        base = len(before) + 1 + end - b
        for q in range(p, min(2 * p - 1, hi - b) + 1):
            back = behind[base - q]
            if ahead[q] + back >= q:
                start, stop = b - back, b + q + ahead[q]
                if q in last and last[q][0] <= start and stop <= last[q][1]:
                    continue  # a run that an earlier boundary has met (one of a smaller period, too)
                last[q] = stretch(ids, q, start, stop)
                if all((ids[start:stop - d] != ids[start + d:stop]).any() for d in (q // r for r in prime_factors(q))):
                    found.append((q, *last[q]))
    return found


# --------------------------------------------------------------------------- Spark
Prepare = Callable[[object, bytes], bytes]
Finish = Callable[[bytes, list[Run], int], tuple]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= ROWS or size > 1 << 22:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def map_runs(docs: DataFrame, finish: Finish, columns: str, min_length: int = 12, prepare: Prepare | None = None) -> DataFrame:
    """doc_id and ``columns`` = finish(text in UTF-8, runs by start and period, number of words) of every row of ``docs``.

    ``prepare(doc_id, text in UTF-8)`` may change a text first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = _parse_datatype_string(columns).fields
    work = _parse_datatype_string("__kind int, __key long, __raw binary, __n long, __p int, __at long, __ids binary, __bounds binary").fields
    kind = docs.schema["doc_id"].dataType
    first, last = (StructType([*some, StructField("doc_id", kind), *given]) for some in (work, []))
    shape = {"first": to_arrow_schema(first), "last": to_arrow_schema(last), PIECE: to_arrow_schema(_parse_datatype_string(PIECE))}
    blank = (None,) * len(given)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key = TaskContext.get().partitionId() << 36
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = text.as_py() or b""
                    raw = prepare(doc_id, raw) if prepare else raw
                    n, needed = tiles(raw, min_length)
                    key, some = key + 1, False
                    for p, at, part, bounds in needed:
                        some = True
                        yield (2, key, None, None, p, at, part.tobytes(), np.array(bounds, np.int32).tobytes(), None, *blank)
                    if some:
                        yield (1, key, raw, n, None, None, None, None, doc_id, *blank)
                    else:
                        yield (0, key, None, None, None, None, None, None, doc_id, *finish(raw, [], n))
        return _batches(rows(), shape["first"])

    held = staged(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(cut, first), "runs", "__kind")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, p, at, ids, bounds in zip(*(c.to_pylist() for c in b.columns)):
                    for q, start, stop in solve(p, np.frombuffer(ids, np.int32), np.frombuffer(bounds, np.int32).tolist()):
                        yield key, q, at + start, at + stop
        return _batches(rows(), shape[PIECE])

    tile = held.filter("__kind = 2").select("__key", "__p", "__at", "__ids", "__bounds").repartition("__key", "__p", "__at")
    runs = stitch(tile.mapInArrow(solved, PIECE), min_length).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    rest = (held.filter("__kind = 1").select(F.col("__key").alias("key"), "doc_id", "__raw", "__n").join(runs, "key", "left")
            .select("doc_id", "__raw", "__n", "runs"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text, n, found in zip(*b.columns):
                    spans = [(r["start"], r["length"], r["period"]) for r in found.as_py() or []]
                    yield doc_id.as_py(), *finish(text.as_py(), spans, n.as_py())
        return _batches(rows(), shape["last"])

    return (held.filter("__kind = 0").select("doc_id", *[f.name for f in given])
            .unionByName(rest.mapInArrow(finished, last)))


def stitch(pieces: DataFrame, min_length: int) -> DataFrame:
    """Pieces (key, period, start, stop) to runs (key, start, length, period): pieces of one period
    that share a period's length or more belong to one run; two runs never share that much."""
    w = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int")
    return (pieces.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
            .groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
            .filter(F.col("length") >= F.greatest(F.lit(min_length), 2 * F.col("period")))
            .select("key", "start", "length", F.col("period").cast("long").alias("period")))


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start and period) and ``text`` without the repeated words."""
    def finish(raw: bytes, runs: list[Run], n: int) -> tuple:
        return [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapse(raw, runs, n)).decode()

    return map_runs(docs, finish, "runs array<struct<start:long,length:long,period:long>>, text string", min_length)


# --------------------------------------------------------------------------- the registered form
def planted(doc_id: object, raw: bytes) -> bytes:
    """The registered query's texts: documents picked by a hash of their id get a periodic tail."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not (words := raw.split()):
        return raw
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def digest(raw: bytes, runs: list[Run], n: int) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    text, between = hashlib.sha256(), b""
    for piece in collapse(raw, runs, n):
        text.update(between + piece)
        between = b" "
    return (len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), text.hexdigest())


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def runs_digest(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest run, and hashes of all runs and of the collapsed text."""
    return map_runs(docs, digest, DIGEST, 12, planted)
