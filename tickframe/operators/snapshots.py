"""Snapshot freshness and the cached snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(events: DataFrame, source_col: str, ts_col: str, max_age_seconds: int) -> DataFrame:
    """Newest snapshot time per source, its age against the newest overall, stale flag.

    One aggregate (a row per source); the overall maximum is a window over that small result.
    """
    s = events.groupBy(source_col).agg(F.max(ts_col).alias("fetched_at"))
    as_of = F.max("fetched_at").over(Window.partitionBy(F.lit(1)))
    return s.select(source_col, "fetched_at", as_of.alias("as_of"),
                    ((F.unix_micros(as_of) - F.unix_micros("fetched_at")) / 1000000).cast("bigint").alias("age_seconds"),
                    (F.col("fetched_at") < as_of - F.expr(f"INTERVAL {max_age_seconds} SECONDS")).alias("is_stale"))


def newest_snapshot(snapshots: DataFrame, as_of: Column, max_age_seconds: int, refresh: bool = False) -> DataFrame:
    """Rows of the newest snapshot (``fetched_at``) at ``as_of``. ``from_cache`` tells whether it
    may still be served: it is younger than the cache lifetime and no refresh was asked for."""
    last = snapshots.filter(F.col("fetched_at") <= as_of).agg(F.max("fetched_at").alias("fetched_at"))
    age = F.unix_seconds(as_of) - F.unix_seconds("fetched_at")
    return snapshots.join(last, "fetched_at").withColumn("from_cache", (age < max_age_seconds) & F.lit(not refresh))
