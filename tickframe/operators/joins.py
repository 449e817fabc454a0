"""Joins of the market tables (inner/left/semi/anti), all equi-joins on declared keys.

No join carries a hint: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` (AQE decides from the shuffle files), and splits
skewed partitions of the shuffle joins that remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_VIEW_COLS = ["symbol", "name", "exchange", "asset_type"]


def active_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("is_active"))


def candles_with_symbols(candles: DataFrame, symbols: DataFrame, active_only: bool = True) -> DataFrame:
    """market_data_with_symbols view (J1/J13/P11): 14 columns, t_stamp renamed to timestamp."""
    s = active_symbols(symbols) if active_only else symbols
    s = s.select(F.col("id").alias("symbol_id"), *SYMBOL_VIEW_COLS)
    j = candles.join(s, "symbol_id")
    return j.select(*SYMBOL_VIEW_COLS, F.col("t_stamp").alias("timestamp"), "open", "high", "low", "close",
                    "volume", "adjusted_close", "time_frame", "data_source", "created_at")


LATEST_PRICE_COLS = ["price", "bid", "ask", "volume_24h", "change_24h", "change_percent_24h",
                     "market_cap", "data_source", "last_updated"]


def latest_prices(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """latest_prices view (J12): prices of active symbols, 14 columns."""
    s = active_symbols(symbols).select(
        F.col("id").alias("symbol_id"), "symbol", "name", "exchange", "asset_type", "currency")
    return prices.join(s, "symbol_id").select(
        "symbol", "name", "exchange", "asset_type", "currency", *LATEST_PRICE_COLS)


def prices_with_symbols(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """All prices with symbol text, name, exchange and asset type (no activity filter)."""
    s = symbols.select(F.col("id").alias("symbol_id"), *SYMBOL_VIEW_COLS)
    return prices.join(s, "symbol_id")


def symbols_left_prices(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """Active symbols left-joined with their prices (a symbol with k sources gives k rows)."""
    p = prices.select(F.col("symbol_id").alias("id"), "price", "last_updated", "data_source")
    return active_symbols(symbols).select("id", "symbol", "name", "exchange", "asset_type").join(p, "id", "left")


def indicators_with_symbols(indicators: DataFrame, symbols: DataFrame) -> DataFrame:
    """technical_indicators_with_symbols view."""
    from .. import schemas as S

    s = active_symbols(symbols).select(F.col("id").alias("symbol_id"), "symbol", "name", "exchange")
    return indicators.join(s, "symbol_id").select(
        "symbol", "name", "exchange", "timestamp", "time_frame", *S.INDICATOR_COLUMNS, "created_at")


def candles_left_indicators(candles: DataFrame, symbols: DataFrame, indicators: DataFrame,
                            match_time_frame: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Symbols x candles left-join indicators on (symbol, time[, time_frame]).

    ``match_time_frame=False`` is the documented form that omits the time frame and so fans
    out across time frames.
    """
    cols = columns or ["sma_20", "rsi_14", "macd"]
    s = symbols.select(F.col("id").alias("symbol_id"), "symbol")
    keys = ["symbol_id", "t_stamp"] + (["time_frame"] if match_time_frame else [])
    ind = indicators.select("symbol_id", F.col("timestamp").alias("t_stamp"),
                            *(["time_frame"] if match_time_frame else []), *cols)
    return (candles.join(s, "symbol_id")
            .join(ind, keys, "left")
            .select("symbol", "symbol_id", F.col("t_stamp").alias("timestamp"), "time_frame", "data_source",
                    "close", *cols))


def resolve_symbols(incoming: DataFrame, symbols: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Name -> id for a whole batch in one join (left: unresolved rows keep a NULL id)."""
    s = symbols.select(F.col("symbol").alias(symbol_col), F.col("id").alias("symbol_id"))
    return incoming.join(s, symbol_col, "left")


def unresolved_symbols(incoming: DataFrame, symbols: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Rows whose symbol is unknown (the reference answers 404 per row)."""
    s = symbols.select(F.col("symbol").alias(symbol_col))
    return incoming.join(s, symbol_col, "left_anti")
