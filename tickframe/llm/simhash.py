"""SimHash near-dedup by anchor points of a covering code.

Fingerprints of 64 bits link when at most ``max_distance`` bits differ. The anchors are the
words of the Hamming code of length 63: it is perfect with covering radius 1, so every point of
the first 63 bits has exactly one anchor within one bit (the last bit takes no part in the choice
of anchors, only in the comparison). Every fingerprint is replicated to all anchors within a
reach, and fingerprints are compared only within an anchor.

Reach. Let x and y differ in d <= t bits, and let z be a point halfway between them: at most
h = ceil(t / 2) bits from either. The anchor within radius 1 of z lies within 1 + h of both, so
replicating to the anchors within covering radius plus half the threshold brings every pair
together. (Radius plus the whole threshold is what a comparison of each fingerprint's home anchor
alone would need: 652 copies instead of 31.5 for t = 2.) Candidates hardly depend on the amount
of data: there are 2^57 anchors, and an anchor can hold at most the distinct fingerprints within
its reach (4,034 for t = 2), whatever the input. That bounds every group; within it, links
are turned into a spanning star, so no anchor emits all pairs.

Exact copies and equal fingerprints are one node from the start. Components are found over
distinct fingerprints with large-star/small-star rounds in the cluster.

Null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows of a
document get the same answer each. A component whose documents all lack an id has a null id.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_pieces, small_batches, staged
from .components import components

CODE_BITS = 63


def text_fingerprint(text: str | None, shingle: int = 3, piece: int = 1 << 20) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles.

    The text is taken in pieces of about ``piece`` bytes, so a very long one needs no more memory.
    """
    digest, ones, n, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in byte_pieces((text or "").encode().lower(), piece):  # bytes: ASCII white space and A-Z only
        words = words[len(words) - min(len(words), shingle - 1):] + part.split()
        if len(words) < shingle:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        view = memoryview(b" ".join(words))
        hashes = np.array([digest(view[a:b], 42) for a, b in zip((ends - sizes).tolist(), ends[shingle - 1:].tolist())], "<u8")
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n and words:
        return digest(b" ".join(words), 42)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((text_fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _errors_by_syndrome(reach: int) -> list[list[int]]:
    """For each syndrome the error words of weight <= reach that have it, as signed 64-bit masks."""
    table: list[list[int]] = [[] for _ in range(64)]
    for w in range(reach + 1):
        for places in combinations(range(1, CODE_BITS + 1), w):
            s = m = 0
            for p in places:
                s, m = s ^ p, m | 1 << (p - 1)
            table[s].append(m)
    return table


def anchors(fp: Column, reach: int) -> Column:
    """All words of the Hamming code within ``reach`` bits of ``fp``'s first 63 bits."""
    bits = fp.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    syndrome = F.lit(0)
    for k in range(6):
        checked = sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(bits.bitwiseAND(F.lit(checked))).bitwiseAND(F.lit(1)), k)
    table = F.array(*[F.array(*[F.lit(m) for m in row]) for row in _errors_by_syndrome(reach)])
    return F.transform(F.get(table, syndrome), lambda m: bits.bitwiseXOR(m))


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))  # of a signed number it would count the absolute value


def _star(fps: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links (each to the first member) that join the parts of ``fps`` connected by <= t bits."""
    out, left = [], fps
    while left.size > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and left.size:
            near = _distance(left, todo.pop()) <= t
            todo += (found := left[near]).tolist()
            out += [(int(root), f) for f in found.tolist()]
            left = left[~near]
    return out


def links(nodes: DataFrame, max_distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within the distance."""
    rows = (nodes.select("fp", F.explode(anchors(F.col("fp"), 1 + (max_distance + 1) // 2)).alias("anchor"))
            .repartition("anchor").sortWithinPartitions("anchor", "fp").select("anchor", "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_a = kept_f = np.empty(0, np.int64)  # the last anchor so far: its rows may go on
        for b in _with_end(batches):
            a = np.concatenate([kept_a, b[0]]) if b else kept_a
            f = np.concatenate([kept_f, b[1]]) if b else kept_f
            if not a.size:
                continue
            starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [a.size]])
            if b:
                kept_a, kept_f = a[starts[-2]:], f[starts[-2]:]
                starts = starts[:-1]
            sizes = np.diff(starts)
            at = starts[:-1][sizes == 2]
            close = _distance(f[at], f[at + 1]) <= max_distance
            found = [(f[at][close], f[at + 1][close])]
            for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if star := _star(f[s:s + n], max_distance):
                    found.append(tuple(np.array(star, np.int64).T))
            x, y = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The batches' two columns as numpy arrays, then None."""
    for b in batches:
        yield b.column(0).to_numpy(), b.column(1).to_numpy()
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included."""
    if not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be 0 to 4: the copies per fingerprint grow with 63^(1 + distance / 2)")
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    roots = components(links(nodes, max_distance)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The registered form: 3-word shingles, at most 2 bits, fingerprints as 16 hex digits."""
    return near_duplicates(docs, 3, 2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the smallest doc_id.

    A document is a doc_id (null counts as a value, above all others) and a text, so two texts of one
    doc_id are two documents; repeated rows of a kept document are reduced to one row.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    groups = near_duplicates(docs.select(own.alias("doc_id"), "text"), shingle, max_distance)
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.text").alias("__text")).distinct()
    named = docs.withColumn("__mark", own["text"])
    kept = named.join(keep, named["doc_id"].eqNullSafe(keep["__id"]) & (named["__mark"] == keep["__text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])
