"""Aggregations: counts, per-class statistics, candles from ticks and candle re-bucketing.

Every aggregate here is partial-aggregable (count, sum, min, max, min_by, max_by), so Spark
combines map-side before the shuffle and a hot symbol never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def asset_type_stats(symbols_left_prices: DataFrame) -> DataFrame:
    """COUNT(*) of joined rows and AVG(price) per asset type, count desc.

    COUNT(*) counts joined rows, so a symbol with two sources counts twice (as in the
    reference SQL). The mean is rounded once, at the output.
    """
    return (symbols_left_prices.groupBy("asset_type")
            .agg(F.count(F.lit(1)).alias("symbol_count"),
                 F.round(F.avg(F.col("price").cast("double")), 6).alias("avg_price"))
            .orderBy(F.col("symbol_count").desc(), "asset_type"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A2: one (table_name, row_count) row per table; each count is its own global aggregate."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------------- bucketing
def bucket_start(ts: Column, time_frame: str) -> Column:
    """Start of the candle bucket containing ``ts`` (UTC).

    Fixed-width frames align to the Unix epoch; 1w starts on Monday, 1M on the 1st
    (calendar month, not the exchange's approximate 21600 minutes).
    """
    if time_frame == "1w":
        return F.date_trunc("week", ts)
    if time_frame == "1M":
        return F.date_trunc("month", ts)
    if time_frame not in S.TIMEFRAME_MINUTES:
        raise ValueError(f"unknown time frame {time_frame!r}")
    secs = S.TIMEFRAME_MINUTES[time_frame] * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / secs) * secs)


def candles_from_ticks(ticks: DataFrame, time_frame: str, ts_col: str = "ts") -> DataFrame:
    """OHLCV per (symbol, source, bucket). open/close = first/last tick by (ts, id)."""
    order = F.struct(F.col(ts_col), F.col("id"))
    return (ticks.withColumn("t_stamp", bucket_start(F.col(ts_col), time_frame))
            .groupBy("symbol_id", "data_source", "t_stamp")
            .agg(F.min_by("price", order).alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"),
                 F.sum("size").cast("bigint").alias("volume"),
                 F.count(F.lit(1)).alias("trades"))
            .withColumn("time_frame", F.lit(time_frame)))


def candles_rollup(candles: DataFrame, time_frame: str) -> DataFrame:
    """Re-bucket finer candles (first open, max high, min low, last close, sum volume)."""
    return (candles.withColumn("bucket", bucket_start(F.col("t_stamp"), time_frame))
            .groupBy("symbol_id", "data_source", "bucket")
            .agg(F.min_by("open", F.col("t_stamp")).alias("open"),
                 F.max("high").alias("high"),
                 F.min("low").alias("low"),
                 F.max_by("close", F.col("t_stamp")).alias("close"),
                 F.sum("volume").cast("bigint").alias("volume"),
                 F.count(F.lit(1)).alias("bars"))
            .withColumnRenamed("bucket", "t_stamp")
            .withColumn("time_frame", F.lit(time_frame)))
