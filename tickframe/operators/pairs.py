"""Pair operators: membership of requests in exchange metadata, incremental cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs as FP


def _normalized(requests: DataFrame) -> DataFrame:
    return requests.select("requested", FP.normalize_pair(F.col("requested")).alias("normalized"))


def requests_offered(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests whose normalised key is a pair in the metadata, else the alternative name of
    one (of the least pair with that name, case ignored). Two equi-joins."""
    p = pairs.select("pair", "status")
    alt = (pairs.filter("altname <> ''").groupBy(F.upper("altname").alias("normalized"))
           .agg(F.min_by(F.struct("pair", "status"), "pair").alias("_alt")))
    j = _normalized(requests).join(p, F.col("normalized") == F.col("pair"), "left").join(alt, "normalized", "left")
    by_key = F.col("pair").isNotNull()
    return j.filter(by_key | F.col("_alt").isNotNull()).select(
        "requested", F.coalesce("pair", "_alt.pair").alias("pair"), F.when(by_key, F.col("status")).otherwise(F.col("_alt.status")).alias("status"),
        F.when(by_key, "pair").otherwise("altname").alias("matched_by"))


def requests_not_offered(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests with no such pair (anti join)."""
    p = pairs.select(F.col("pair").alias("normalized"))
    return _normalized(requests).join(p, "normalized", "left_anti")


def newer_than_stored(fetched: DataFrame, stored: DataFrame, series: list[str], ts_col: str = "t_stamp") -> DataFrame:
    """Per-series high-water mark of the stored table; keep fetched rows past it.

    The mark is one aggregated row per series (partial aggregation, then a join on the
    series key), so the stored table is never shipped whole.
    """
    hwm = stored.groupBy(*series).agg(F.max(ts_col).alias("_hwm"))
    j = fetched.join(hwm, series, "left")
    return j.filter(F.col("_hwm").isNull() | (F.col(ts_col) > F.col("_hwm"))).drop("_hwm")


def page_meta(filtered: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: limit, offset, rows returned by the page, has_more, total (one count)."""
    total = F.count(F.lit(1))
    return filtered.agg(
        F.lit(limit).alias("page_limit"), F.lit(offset).alias("page_offset"),
        F.greatest(F.least(F.lit(limit).cast("bigint"), total - offset), F.lit(0).cast("bigint")).alias("returned"),
        (F.lit(offset + limit) < total).alias("has_more"),
        total.alias("total"))
