"""Distributed selection: where a sorted column's weight reaches a given sum, without sorting it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

TIE = "__tie"


def tie_hash(c: str) -> Column:
    """A hash of ``c`` that a double holds exactly, to order rows of equal value."""
    return F.xxhash64(c).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")


def pick(values: list, node: str = "__node") -> Column:
    """values[node], as a literal array."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(node))


def weighted_cut(rows: DataFrame, value: Column, nodes: list[dict], want: list[float], bins: int) -> list[dict | None]:
    """For each node the largest value v whose rows up to v weigh at most ``want``, with what
    they weigh (below) and what the rows of the next value up weigh (at).

    ``rows`` has __node, size and everything ``value`` needs; rows with a null value don't count.
    """
    span = (rows.select("__node", value.alias("v"), "size").filter(F.col("v").isNotNull()))
    lo: list[float | None] = [None] * len(nodes)
    hi: list[float | None] = [None] * len(nodes)
    below = [0.0] * len(nodes)
    done: list[dict | None] = [None] * len(nodes)
    for r in span.groupBy("__node").agg(F.min("v"), F.max("v"), F.sum("size")).collect():
        lo[r[0]], hi[r[0]] = r[1], r[2]
        if r[1] == r[2]:
            done[r[0]] = {"v": r[1], "below": 0.0, "at": float(r[3])}
    while any(d is None and x is not None for d, x in zip(done, lo)):
        live = [d is None and x is not None for d, x in zip(done, lo)]
        low, high = pick([x if k else 1.0 for x, k in zip(lo, live)]), pick([x if k else 0.0 for x, k in zip(hi, live)])
        at = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        sums = (span.filter(F.col("v").between(low, high)).groupBy("__node", at.alias("bin"))
                .agg(F.sum("size").alias("w"), F.min("v").alias("least"), F.max("v").alias("most")).collect())
        for n in (i for i, k in enumerate(live) if k):
            for r in sorted((r for r in sums if r["__node"] == n), key=lambda r: r["least"]):
                if below[n] + r["w"] > want[n] or r["most"] >= hi[n]:
                    lo[n], hi[n] = r["least"], r["most"]
                    if r["least"] == r["most"]:
                        done[n] = {"v": r["least"], "below": below[n], "at": float(r["w"])}
                    break
                below[n] += r["w"]
    return done


def top_rows(rows: DataFrame, key: str, tie: str, k: int, bins: int = 4096) -> DataFrame:
    """``rows`` with a boolean ``selected``: the k rows of the largest double ``key``.

    Of rows with the key at the border those with the least hash of ``tie`` come first; rows that
    share that too (repeated rows) are selected together or not at all. A null key is never selected.
    """
    one = [{"n": 1}]
    span = rows.select(F.lit(0).alias("__node"), (-F.col(key)).alias("__v"), tie_hash(tie).alias(TIE), F.lit(1).alias("size"))
    at = weighted_cut(span, F.col("__v"), one, [float(k)], bins)[0]
    if at is None or k <= 0:
        return rows.withColumn("selected", F.lit(False))
    rest = k - at["below"]
    if rest >= at["at"]:
        most = math.inf
    else:
        tied = weighted_cut(span.filter(F.col("__v") == at["v"]), F.col(TIE), one, [float(rest)], bins)[0]
        most = tied["v"] if rest - tied["below"] >= tied["at"] else math.nextafter(tied["v"], -math.inf)
    v, t = -F.col(key), tie_hash(tie)
    return rows.withColumn("selected", F.coalesce((v < at["v"]) | ((v == at["v"]) & (t <= most)), F.lit(False)))
