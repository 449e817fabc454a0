"""Sharding by a k-d tree over document metadata (DataFrame functions only).

Each node of the tree holds some of the shards. It is split at the weighted median (weight:
bytes) along its widest metadata dimension, so that each child gets bytes in proportion to its
number of shards, until every leaf holds one shard and so the target bytes (total / shards).

The medians of all nodes of a level are found together: every row's value falls in one of
``bins`` bins of its node's interval, the bins' bytes are summed where the rows lie, and the
bin that holds the median becomes the next interval. A round brings at most
``shards * bins`` rows to the driver, whatever the input; a few rounds single out one value.
Rows that share it are split at the median of a hash of doc_id in the same way, so a value
that a third of all rows share is divided too. Only metadata is written and read again; texts
are read once and never shuffled.

Dimensions are normalised to their range over all rows; strings count as their rank among the
distinct values, which are sorted by ranges over all tasks and joined to the rows. Null texts weigh the fixed cost alone,
null dimensions lie below all others, rows without doc_id share one hash, repeated rows stay
together. With fewer documents than shards some shards stay empty; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .select import TIE, pick, tie_hash, weighted_cut


def with_rank(rows: DataFrame, c: str) -> DataFrame:
    """``rows`` with the text column ``c`` replaced by its rank among the distinct values, from 1 as a double; null is -1.

    The values are numbered within ranges of them; each range adds what the ranges before it hold.
    """
    values = rows.select(F.col(c).alias("__value")).filter(F.col("__value").isNotNull()).distinct()
    at = staged(values.repartitionByRange("__value").sortWithinPartitions("__value").select("__value", F.spark_partition_id().alias("__part")), "kd-values")
    sizes = at.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__value"))
    ranks = at.join(before, "__part").select("__value", (nth + F.col("__before")).cast("double").alias("__rank"))
    return (rows.join(ranks, rows[c] == ranks["__value"], "left").withColumn(c, F.coalesce("__rank", F.lit(-1.0))).drop("__value", "__rank"))


def kd_tree(meta: DataFrame, dims: list[str], shards: int, bins: int = 512) -> DataFrame:
    """``meta`` (size, the tie hash and double columns ``dims``) with an int column ``shard``."""
    span = meta.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    spread = [max(span[2 * i + 1] - span[2 * i], 1e-300) if span[0] is not None else 1.0 for i in range(len(dims))]
    rows = meta.withColumn("__node", F.lit(0))
    level = [{"first": 0, "n": shards}]
    while any(n["n"] > 1 for n in level):
        seen = {r["__node"]: r for r in rows.groupBy("__node").agg(
            F.sum("size").alias("w"), *[f(d).alias(f"{k}{i}") for i, d in enumerate(dims)
                                        for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        dim, want = [], []
        for i, n in enumerate(level):
            r = seen.get(i)
            wide = [(r[f"hi{k}"] - r[f"lo{k}"]) / spread[k] if r else 0.0 for k in range(len(dims))]
            dim.append(wide.index(max(wide)))
            want.append(float(r["w"]) * (n["n"] // 2) / n["n"] if r else 0.0)
        split = [n["n"] > 1 for n in level]
        value = F.when(pick(split), F.get(F.array(*dims), pick(dim)))
        first = weighted_cut(rows, value, level, want, bins)
        v = [c["v"] if c else 0.0 for c in first]
        rest = [w - c["below"] if c else 0.0 for w, c in zip(want, first)]
        tied = weighted_cut(rows, F.when(value == pick(v), F.col(TIE)), level, rest, bins)
        # the rows of the median hash go to the side that they bring nearer to its share
        t = [(c["v"] if 2 * (r - c["below"]) >= c["at"] else math.nextafter(c["v"], -math.inf)) if c else -1.0
             for r, c in zip(rest, tied)]
        right = (value > pick(v)) | ((value == pick(v)) & (F.col(TIE) > pick(t)))
        after: list[dict] = []
        left_at, right_at = [], []
        for n in level:
            left_at.append(len(after))
            if n["n"] > 1:
                half = n["n"] // 2
                after += [{"first": n["first"], "n": half}, {"first": n["first"] + half, "n": n["n"] - half}]
            else:
                after.append(n)
            right_at.append(len(after) - 1)
        rows = staged(rows.withColumn("__node", F.when(F.coalesce(right, F.lit(False)), pick(right_at))
                                      .otherwise(pick(left_at))), "kd-level")
        level = after
    return rows.withColumn("shard", pick([n["first"] for n in level])).drop("__node")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, bins: int = 512) -> DataFrame:
    """doc_id, size (UTF-8 bytes + overhead), text_crc32, shard and slot (gapless from 0 in each shard).

    Slots are numbered in blocks of rows by a hash of doc_id and shifted by the blocks' counts, so
    that no task orders a whole shard.
    """
    meta = staged(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"),
        tie_hash("doc_id").alias(TIE),
    ).withColumn("__size", F.log2(F.col("size").cast("double"))), "kd-meta")
    meta = staged(with_rank(with_rank(meta, "__source"), "__lang"), "kd-ranked")
    rows = kd_tree(meta, ["__source", "__lang", "__size"], shards, bins)

    blocks = max(8, meta.count() // (shards * 100_000))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(blocks)))
    before = "sum(n) OVER (PARTITION BY shard ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n"
    starts = (rows.groupBy("shard", "__block").agg(F.count("*").alias("n"))
              .select("shard", "__block", F.expr(before).alias("__start")))
    order = "row_number() OVER (PARTITION BY shard, __block ORDER BY doc_id, size, text_crc32) - 1"
    return (rows.withColumn("__nth", F.expr(order)).join(starts, ["shard", "__block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("__start") + F.col("__nth")).cast("long").alias("slot")))


def shard_digest(docs: DataFrame) -> DataFrame:
    """The registered form: 40 shards of near equal bytes."""
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))
