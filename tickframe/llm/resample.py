"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (word and punctuation tokens, single and in pairs, in
``buckets`` buckets) are fitted: one to target text (documents labelled good) and one to the raw
corpus. A document's log weight is the sum over its n-grams of the log ratio of their
probabilities. Gumbel noise is added, and the k documents of the largest sum are selected: a
sample of k documents without replacement, in proportion to the weights (Gumbel top-k).

The raw model counts every document. The target model uses at most ``target_rows`` labelled
documents (those of the least hash of doc_id). Per task, counts are kept in ``buckets`` numbers,
so what is shuffled and what the driver reads (two times ``buckets`` sums) is bounded. k is
``keep`` of all documents; by default it is the labels' share of good documents, raised by
``margin`` standard errors. The k-th largest sum is found by distributed selection, not by a sort.
The noise is a hash of doc_id and ``seed``, so a rerun selects the same documents.

Null and empty texts have no n-grams and log weight 0. Rows without doc_id share one noise value.
Repeated rows share their fate. Without any good label every ratio is 1 and the selection is
uniform; an empty table gives an empty result. Other columns are carried by ``select_documents``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_pieces, small_batches, staged
from .select import top_rows

#: Runs of letters, digits and bytes beyond ASCII, and runs of other characters that aren't white space.
TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+").findall
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
OPTIONS = {"buckets": 10_000, "target_rows": 20_000, "smoothing": 1.0}


def ngrams(text: str | None, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the text's tokens and token pairs, in pieces of a bounded size."""
    last = np.empty(0, np.uint64)
    for piece in byte_pieces((text or "").encode()):
        found = TOKENS(piece)
        one = np.concatenate([last, np.fromiter(map(crc32, found), np.uint64, len(found))])
        new = one[len(last):]
        two = one[:-1] * MIX[1] + one[1:] * MIX[2]
        last = one[-1:]
        yield ((np.concatenate([new * MIX[0], two]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: list[int], buckets: int) -> np.ndarray:
    """Counts (2, buckets): of the target documents and of all documents."""
    small_batches(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for g in ngrams(text, buckets):
                    c = np.bincount(g, minlength=buckets)
                    counts[1] += c
                    if doc_id in wanted.value:
                        counts[0] += c
        model, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(model * buckets + bucket), pa.array(counts[model, bucket])], ["slot", "n"])

    out = np.zeros(2 * buckets, np.int64)
    for r in docs.select("doc_id", "text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out.reshape(2, buckets)


def target_sample(labels: DataFrame, target_rows: int) -> list[int]:
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()]


def log_ratios(counts: np.ndarray, smoothing: float) -> np.ndarray:
    target, raw = (np.log(c + smoothing) - math.log(c.sum() + smoothing * len(c)) for c in counts)
    return target - raw if counts[0].any() else np.zeros(counts.shape[1])


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, log_weight, n_grams) of every document."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = table.value
        for b in batches:
            sums = [[(float(r[g].sum()), len(g)) for g in ngrams(t, len(r))] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([math.fsum(x for x, _ in s) for s in sums], pa.float64()),
                 pa.array([sum(n for _, n in s) for s in sums], pa.int64())], ["doc_id", "text_hash", "log_weight", "n_grams"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, log_weight double, n_grams long")


def gumbel(seed: int):
    """Gumbel noise from a uniform hash of doc_id in (0, 1)."""
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def good_share(labels: DataFrame, margin: float) -> float:
    """The labels' share of good documents, raised by ``margin`` standard errors."""
    r = labels.agg(F.count("quality").alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("good")).first()
    p = (r.good or 0) / r.n if r.n else 1.0
    return min(1.0, p + margin * math.sqrt(p * (1 - p) / r.n)) if r.n else 1.0


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 11, margin: float = 2.0, **options) -> DataFrame:
    """(doc_id, log_weight, n_grams, gumbel_key, selected) of every document."""
    return judged(docs, labels, keep, seed, margin, **options).drop("text_hash")


def judged(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 11, margin: float = 2.0, **options) -> DataFrame:
    """``resample`` with the ``text_hash`` that tells a row's text."""
    given = {**OPTIONS, **options}
    counts = bucket_counts(docs, target_sample(labels, given["target_rows"]), given["buckets"])
    scored = staged(log_weights(docs, log_ratios(counts, given["smoothing"]))
                    .withColumn("gumbel_key", F.col("log_weight") + gumbel(seed)), "log-weights")
    share = good_share(labels, margin) if keep is None else keep
    return top_rows(scored, "gumbel_key", "doc_id", math.ceil(scored.count() * share))


def select_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not selected; a document is a doc_id (null counts as a
    value) and a text, so no other text of the same doc_id goes with it."""
    gone = judged(docs, labels, **options).filter("NOT selected").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64("text") == F.col("__text")), "left_anti")
