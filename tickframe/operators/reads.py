"""Reads: lookups, filters, paging and top-k over the market tables.

The reference applies its optional filters after LIMIT/OFFSET (so pages can come back
short). Every function here filters first; ``limit_first=True`` reproduces the reference's
order where it differs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (_dt.datetime, _dt.date)):
        v = v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    return F.lit(str(v).replace("T", " ").replace("Z", "")).cast("timestamp")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY ... OFFSET o LIMIT n (a top-(o+n) sort; no global sort of the table)."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be >= 1 and offset >= 0")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


# --------------------------------------------------------------------------- symbols
def symbols_page(symbols: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols ordered by symbol, paged."""
    return page(symbols, [F.col("symbol"), F.col("id")], limit, offset)


def symbols_after(symbols: DataFrame, last: str | None, limit: int = 100) -> DataFrame:
    """L1 by key: the page that follows symbol ``last`` (None: the first). The filter prunes what
    came before, so a deep page costs no more than the first."""
    rest = symbols if last is None else symbols.filter(F.col("symbol") > last)
    return page(rest, [F.col("symbol"), F.col("id")], limit)


def symbol_lookup(symbols: DataFrame, symbol: str | list[str]) -> DataFrame:
    """Equality lookup by symbol text."""
    names = [symbol] if isinstance(symbol, str) else list(symbol)
    return symbols.filter(F.col("symbol").isin(names))


def symbols_filtered(symbols: DataFrame, is_active: bool | None = True, asset_type: str | None = None,
                     exchange: str | None = None, limit: int | None = None, offset: int = 0,
                     limit_first: bool = False) -> DataFrame:
    """Optional is_active / asset_type / exchange filters (None = no filter)."""
    def filt(df: DataFrame) -> DataFrame:
        if is_active is not None:
            df = df.filter(F.col("is_active") == F.lit(is_active))
        if asset_type is not None:
            df = df.filter(F.col("asset_type") == asset_type)
        if exchange is not None:
            df = df.filter(F.col("exchange") == exchange)
        return df
    if limit is None:
        return filt(symbols)
    if limit_first:
        return filt(symbols_page(symbols, limit, offset))
    return symbols_page(filt(symbols), limit, offset)


# --------------------------------------------------------------------------- candles
def month_bounds(lo, hi) -> Column | None:
    """Predicate on the storage partition column ``year_month`` implied by a ts range.

    Catalyst does not derive a partition filter from a filter on ``t_stamp``; adding it
    lets a partitioned scan skip whole months.
    """
    conds = []
    if lo is not None:
        conds.append(F.col("year_month") >= F.date_format(_ts(lo), "yyyy-MM"))
    if hi is not None:
        conds.append(F.col("year_month") <= F.date_format(_ts(hi), "yyyy-MM"))
    if not conds:
        return None
    c = conds[0]
    for x in conds[1:]:
        c = c & x
    return c


def time_range(df: DataFrame, lo=None, hi=None, ts_col: str = "t_stamp") -> DataFrame:
    """Both ends inclusive, each optional. Adds the month-partition filter when present."""
    if lo is not None:
        df = df.filter(F.col(ts_col) >= _ts(lo))
    if hi is not None:
        df = df.filter(F.col(ts_col) <= _ts(hi))
    if "year_month" in df.columns:
        m = month_bounds(lo, hi)
        if m is not None:
            df = df.filter(m)
    return df


def symbol_id_of(symbols: DataFrame, symbol: str) -> int | None:
    """P1 point lookup: the id of one symbol (a single scalar read), or None."""
    row = symbols.filter(F.col("symbol") == symbol).select("id").limit(1).collect()
    return row[0][0] if row else None


def candles_for(candles: DataFrame, symbols: DataFrame, symbol: str | None, time_frame: str = "1d") -> DataFrame:
    """Candles of one symbol (or all) and time frame, with symbol text and name.

    For one symbol the id is looked up first, so ``symbol_id = <id>`` reaches the candle
    scan as a pushed-down filter (row-group skipping on the sorted files) instead of joining
    the whole table against a one-row dimension.
    """
    c = candles.filter(F.col("time_frame") == time_frame)
    s = symbols.select(F.col("id").alias("symbol_id"), "symbol", "name")
    if symbol is not None:
        sid = symbol_id_of(symbols, symbol)
        s = s.filter(F.col("symbol") == symbol)
        c = c.filter(F.col("symbol_id") == F.lit(sid if sid is not None else -1).cast("int"))
    return c.join(s, "symbol_id")


def candles_latest(candles: DataFrame, symbols: DataFrame, symbol: str | None, time_frame: str = "1d",
                   limit: int = 100, lo=None, hi=None, limit_first: bool = False) -> DataFrame:
    """L2 (+P6): latest ``limit`` candles of a series, newest first, optional inclusive range."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be in 1..1000")
    base = candles_for(candles, symbols, symbol, time_frame)
    order = [F.col("t_stamp").desc(), F.col("data_source"), F.col("id").desc()]
    if limit_first:
        return time_range(base.orderBy(*order).limit(limit), lo, hi)
    return time_range(base, lo, hi).orderBy(*order).limit(limit)


def latest_n_per_series(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest ``n`` rows per key (row_number <= n; planned as a WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# --------------------------------------------------------------------------- prices
def prices_latest(prices_joined: DataFrame, limit: int = 100, symbol: str | None = None,
                  limit_first: bool = False) -> DataFrame:
    """Newest prices first; optional symbol filter."""
    order = [F.col("last_updated").desc(), F.col("id").desc()]
    flt = (lambda d: d.filter(F.col("symbol") == symbol)) if symbol is not None else (lambda d: d)
    if limit_first:
        return flt(prices_joined.orderBy(*order).limit(limit))
    return flt(prices_joined).orderBy(*order).limit(limit)


def nullify_optional(df: DataFrame, cols: list[str]) -> DataFrame:
    """The API treats a numeric 0 in an optional field as missing."""
    return df.select(*[F.nullif(F.col(c), F.lit(0)).alias(c) if c in cols else F.col(c) for c in df.columns])


# --------------------------------------------------------------------------- validation
def candle_violations() -> Column:
    """Array of rule names a candle row breaks (empty array = valid)."""
    rules = [
        ("open_not_positive", ~(F.col("open") > 0)),
        ("high_not_positive", ~(F.col("high") > 0)),
        ("low_not_positive", ~(F.col("low") > 0)),
        ("close_not_positive", ~(F.col("close") > 0)),
        ("volume_negative", ~(F.col("volume") >= 0)),
        ("bad_time_frame", ~F.coalesce(F.col("time_frame").rlike(S.TIMEFRAME_PATTERN), F.lit(False))),
    ]
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def validate_candles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantine-with-reasons) in one pass over the input."""
    tagged = df.withColumn("violations", candle_violations())
    return (tagged.filter(F.size("violations") == 0).drop("violations"),
            tagged.filter(F.size("violations") > 0))


def price_violations() -> Column:
    """A price row must have price > 0."""
    arr = F.array(F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), F.lit("price_not_positive")))
    return F.filter(arr, lambda x: x.isNotNull())


def validate_prices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split incoming price rows into (valid, quarantine-with-reasons) in one pass."""
    tagged = df.withColumn("violations", price_violations())
    return (tagged.filter(F.size("violations") == 0).drop("violations"),
            tagged.filter(F.size("violations") > 0))


# --------------------------------------------------------------------------- time frames
def timeframes_by_symbol(candles: DataFrame, symbols: DataFrame, symbol: str | None = None) -> DataFrame:
    """Distinct non-empty time frames per symbol, binary text order.

    Batch form: one row per (symbol, time_frame); the distinct is partial-aggregated per
    partition before the shuffle, so a hot symbol does not pile into one task.
    """
    c = candles.select("symbol_id", "time_frame").filter(
        F.col("time_frame").isNotNull() & (F.col("time_frame") != ""))
    s = symbols.select(F.col("id").alias("symbol_id"), "symbol")
    if symbol is not None:
        s = s.filter(F.col("symbol") == symbol)
    return c.join(s, "symbol_id").select("symbol", "time_frame").distinct()


def timeframe_lists(candles: DataFrame, symbols: DataFrame) -> DataFrame:
    """A3/L9 batch form: per symbol, its distinct time frames as a list in binary text order
    (the reference's ORDER BY) and in duration order (F5 minutes). The set per symbol is
    bounded by the number of time frames."""
    from ..functions.timeframes import timeframe_minutes

    c = candles.select("symbol_id", "time_frame").filter(
        F.col("time_frame").isNotNull() & (F.col("time_frame") != "")).distinct()
    s = symbols.select(F.col("id").alias("symbol_id"), "symbol")
    g = c.join(s, "symbol_id").groupBy("symbol").agg(
        F.array_sort(F.collect_set("time_frame")).alias("time_frames"),
        F.array_sort(F.collect_set(F.struct(timeframe_minutes(F.col("time_frame")).alias("m"),
                                            F.col("time_frame").alias("t")))).alias("_d"))
    return g.select("symbol", "time_frames", F.transform("_d", lambda x: x["t"]).alias("time_frames_by_duration"))
