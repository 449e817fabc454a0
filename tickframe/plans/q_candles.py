"""Registered candle-building queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import timeframes as FT
from ..operators import merge as M
from ..operators import reads as R
from ..operators import stats as A
from ..session import fresh_path
from ..sources.catalog import MarketTables
from .registry import query


@query("candles_from_ticks", """
SELECT symbol_id, data_source, date_trunc('hour', ts) AS t_stamp,
       arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close,
       CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades, '1h' AS time_frame
FROM ticks_t GROUP BY symbol_id, data_source, date_trunc('hour', ts)
""")
def candles_from_ticks(t: MarketTables) -> DataFrame:
    """Hourly OHLCV bars from ticks per (symbol, source)."""
    return A.candles_from_ticks(t.ticks, "1h")


@query("candles_from_ticks_5m", """
SELECT symbol_id, data_source, time_bucket(INTERVAL '5 minutes', ts) AS t_stamp,
       arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close,
       CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades, '5m' AS time_frame
FROM ticks_t GROUP BY symbol_id, data_source, time_bucket(INTERVAL '5 minutes', ts)
""")
def candles_from_ticks_5m(t: MarketTables) -> DataFrame:
    """5-minute bars from ticks."""
    return A.candles_from_ticks(t.ticks, "5m")


_ROLL = """
SELECT symbol_id, data_source, date_trunc('{unit}', t_stamp) AS t_stamp,
       arg_min(open, t_stamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, t_stamp) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars, '{tf}' AS time_frame
FROM candles_t GROUP BY symbol_id, data_source, date_trunc('{unit}', t_stamp)"""


def _rollups(t: MarketTables) -> DataFrame:
    return A.candles_rollup(t.candles, "1w").unionByName(A.candles_rollup(t.candles, "1M"))


@query("candles_rollup", _ROLL.format(unit="week", tf="1w") + "\nUNION ALL" + _ROLL.format(unit="month", tf="1M"))
def candles_rollup(t: MarketTables) -> DataFrame:
    """Daily bars re-bucketed to weekly (Monday) and calendar-monthly bars."""
    return _rollups(t)


_TF_MIN_SQL = "CASE time_frame " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in S.TIMEFRAME_MINUTES.items()) + " ELSE 60 END"


@query("timeframe_minutes", f"""
SELECT time_frame, {_TF_MIN_SQL} AS minutes,
       count(*) AS bars
FROM (SELECT time_frame FROM candles_t UNION ALL SELECT '1w' FROM candles_t GROUP BY symbol_id, data_source, date_trunc('week', t_stamp)
      UNION ALL SELECT '1M' FROM candles_t GROUP BY symbol_id, data_source, date_trunc('month', t_stamp))
GROUP BY time_frame
""")
def timeframe_minutes(t: MarketTables) -> DataFrame:
    """exchange interval (minutes) of every time frame stored, with its bar count."""
    allc = t.candles.select("time_frame").unionByName(_rollups(t).select("time_frame"))
    return allc.groupBy("time_frame").agg(F.count(F.lit(1)).alias("bars")).select(
        "time_frame", FT.timeframe_minutes(F.col("time_frame")).alias("minutes"), "bars")


@query("candles_validate", """
SELECT time_frame, CAST(count_if(ok) AS BIGINT) AS valid_rows, CAST(count_if(NOT ok) AS BIGINT) AS invalid_rows FROM (
  SELECT time_frame, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0
         AND regexp_full_match(time_frame, '(1m|5m|15m|30m|1h|4h|1d|1w|1M)'), false) AS ok
  FROM (SELECT time_frame, open, high, low, close, volume FROM candles_t
        UNION ALL SELECT '1h', arg_min(price, (ts, id)), max(price), min(price), arg_max(price, (ts, id)), CAST(sum(size) AS BIGINT)
        FROM ticks_t GROUP BY symbol_id, data_source, date_trunc('hour', ts)))
GROUP BY time_frame
""")
def candles_validate(t: MarketTables) -> DataFrame:
    """Split stored and tick-built candles into valid rows and quarantine."""
    cols = ["time_frame", "open", "high", "low", "close", "volume"]
    allc = t.candles.select(*cols).unionByName(A.candles_from_ticks(t.ticks, "1h").select(*cols))
    tagged = allc.withColumn("ok", F.size(R.candle_violations()) == 0)
    return tagged.groupBy("time_frame").agg(F.count_if("ok").alias("valid_rows"),
                                            F.count_if(~F.col("ok")).alias("invalid_rows"))


@query("candles_partitioned", """
SELECT time_frame, strftime(t_stamp, '%Y-%m') AS year_month, count(*) AS row_count, min(t_stamp) AS first_ts, max(t_stamp) AS last_ts,
       true AS in_its_month
FROM candles_t GROUP BY ALL
""")
def candles_partitioned(t: MarketTables) -> DataFrame:
    """What lies in each (time frame, month) partition of the stored candle table."""
    stored = M.read_candles(t.spark, M.write_candles(t.candles, fresh_path(t.spark, "market_data")))
    return stored.groupBy("time_frame", "year_month").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("t_stamp").alias("first_ts"), F.max("t_stamp").alias("last_ts"),
        F.bool_and(F.date_format("t_stamp", "yyyy-MM") == F.col("year_month")).alias("in_its_month"))


@query("candles_bucketed_stats", """
SELECT s.symbol, count(*) AS bars, min(c.t_stamp) AS first_ts, max(c.t_stamp) AS last_ts, CAST(max(c.high) AS DECIMAL(20, 8)) AS high
FROM candles_t c JOIN symbols_t s ON s.id = c.symbol_id GROUP BY s.symbol, c.symbol_id
""")
def candles_bucketed_stats(t: MarketTables) -> DataFrame:
    """Bars per symbol from the bucketed candle table: grouped by the bucket column without a shuffle."""
    name = f"candles_{uuid.uuid4().hex[:12]}"
    table = M.write_bucketed(t.candles, name, fresh_path(t.spark, "market_data_bucketed"))
    per = table.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("bars"), F.min("t_stamp").alias("first_ts"), F.max("t_stamp").alias("last_ts"),
                                         F.max("high").alias("high"))
    return per.join(t.symbols.select(F.col("id").alias("symbol_id"), "symbol"), "symbol_id").select("symbol", "bars", "first_ts", "last_ts", "high")


@query("timeframes_sorted", f"""
WITH tf AS (SELECT DISTINCT symbol_id, time_frame FROM (
  SELECT symbol_id, time_frame FROM candles_t
  UNION ALL SELECT symbol_id, '1w' FROM candles_t
  UNION ALL SELECT symbol_id, '1M' FROM candles_t))
SELECT s.symbol, list_sort(list(tf.time_frame)) AS time_frames,
       list_transform(list_sort(list({{'m': {_TF_MIN_SQL}, 't': tf.time_frame}})), lambda x: x.t) AS time_frames_by_duration
FROM tf JOIN symbols_t s ON s.id = tf.symbol_id
GROUP BY s.symbol
""")
def timeframes_sorted(t: MarketTables) -> DataFrame:
    """Per symbol, stored time frames (daily bars plus their weekly and monthly
    roll-ups) sorted as text and by duration."""
    cols = ["symbol_id", "time_frame"]
    allc = t.candles.select(*cols).unionByName(_rollups(t).select(*cols))
    return R.timeframe_lists(allc, t.symbols)
