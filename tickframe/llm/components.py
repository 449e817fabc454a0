"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is an aggregate and a join, both split by Spark where a node has very many edges;
no node's neighbours are ever gathered. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    """(a, b) with the least of a and all its b as ``m``."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select("a", "b", F.least("a", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Nodes of no edge do not appear. Self-links and repeated edges are harmless; null ends are
    left out.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "cc")
    state, last = _state(edges), None
    while state[0] and state != last:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        stars = _least(large)
        small = (stars.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(stars.select("a", F.col("m").alias("b"))).distinct())
        edges = staged(small, "cc")
        state, last = _state(edges), state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
