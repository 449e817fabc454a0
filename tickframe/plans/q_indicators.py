"""Registered indicator queries (I1-I14, J4, J5) and their DuckDB formulation.

The oracle computes sliding frames with ``list(...) OVER`` + ``list_sum`` and the
recurrences with one recursive CTE stepping each series by row number, both summing left to
right like the Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import indicators as I
from ..operators import joins as J
from ..sources.catalog import MarketTables
from .registry import query

KEY = ["symbol_id", "timestamp", "time_frame"]


def _f(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _ab(n: int) -> tuple[str, str]:
    a = 2.0 / (n + 1)
    return _f(a), _f(1.0 - a)


A12, B12 = _ab(12)
A26, B26 = _ab(26)
A9, B9 = _ab(9)

SERIES_SQL = """
bars AS (
  SELECT symbol_id, time_frame, t_stamp, data_source, open, high, low, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol_id, time_frame, t_stamp ORDER BY data_source) AS k
    FROM candles_t) WHERE k = 1
),
wb AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
         (high + low + close) / 3 AS tp
  FROM bars WINDOW w AS (PARTITION BY symbol_id, time_frame ORDER BY t_stamp)
),
wl AS (
  SELECT *,
""" + ",\n".join(
    f"    list(close) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
    for n in I.SMA_PERIODS) + """,
    list(tp) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tp20,
    list(volume) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20,
    min(low) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ll14,
    max(high) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS hh14,
    sum(CAST(coalesce(sign(close - pc), 0) AS DOUBLE) * volume) OVER (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv
  FROM wb
),
wm AS (
  SELECT *,
""" + ",\n".join(f"    CASE WHEN rn >= {n} THEN list_sum(c{n}) / {n} END AS sma_{n}" for n in I.SMA_PERIODS) + """,
    list_sum(tp20) / 20 AS tp_sma,
    CASE WHEN rn >= 20 THEN round_even(list_sum(list_transform(v20, lambda x: CAST(x AS DOUBLE))) / 20, 0) END AS vsma
  FROM wl
),
wi AS (
  SELECT *,
    CASE WHEN rn >= 20 THEN sma_20 + sqrt(list_sum(list_transform(c20, lambda x: (x - sma_20) * (x - sma_20))) / 20) * 2 END AS bollinger_upper,
    sma_20 AS bollinger_middle,
    CASE WHEN rn >= 20 THEN sma_20 - sqrt(list_sum(list_transform(c20, lambda x: (x - sma_20) * (x - sma_20))) / 20) * 2 END AS bollinger_lower,
    CASE WHEN rn >= 14 AND hh14 - ll14 <> 0 THEN (close - ll14) * 100 / (hh14 - ll14) END AS stoch_k,
    CASE WHEN rn >= 14 AND hh14 - ll14 <> 0 THEN (hh14 - close) * -100 / (hh14 - ll14) END AS williams_r,
    CAST(vsma AS BIGINT) AS volume_sma_20,
    CASE WHEN rn >= 20 AND list_sum(list_transform(tp20, lambda x: abs(x - tp_sma))) / 20 <> 0
         THEN (tp - tp_sma) / ((list_sum(list_transform(tp20, lambda x: abs(x - tp_sma))) / 20) * 0.015) END AS cci
  FROM wm
),
wd AS (
  SELECT *,
    CASE WHEN count(stoch_k) OVER k3 = 3 THEN list_sum(list(stoch_k) OVER k3) / 3 END AS stoch_d
  FROM wi WINDOW k3 AS (PARTITION BY symbol_id, time_frame ORDER BY t_stamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
)"""

REC_SQL = f"""
xb AS (
  SELECT symbol_id, time_frame, rn, close,
    CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN rn > 1 AND close - pc > 0 THEN close - pc ELSE CAST(0 AS DOUBLE) END AS g,
    CASE WHEN rn > 1 AND close - pc < 0 THEN -(close - pc) ELSE CAST(0 AS DOUBLE) END AS lo,
    CASE WHEN rn > 1 AND high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE CAST(0 AS DOUBLE) END AS pdm,
    CASE WHEN rn > 1 AND pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE CAST(0 AS DOUBLE) END AS mdm
  FROM wb
),
rec AS (
  SELECT symbol_id, time_frame, rn, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig,
         CAST(0 AS DOUBLE) AS gs, CAST(0 AS DOUBLE) AS ls, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al,
         CAST(0 AS DOUBLE) + tr AS trs, CAST(NULL AS DOUBLE) AS atr,
         CAST(0 AS DOUBLE) AS ps, CAST(0 AS DOUBLE) AS ms, CAST(0 AS DOUBLE) AS ts,
         CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DOUBLE) AS sm, CAST(NULL AS DOUBLE) AS st,
         CAST(NULL AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dxs, CAST(NULL AS DOUBLE) AS adx
  FROM xb WHERE rn = 1
  UNION ALL
  SELECT symbol_id, time_frame, rn, e12, e26, sig, gs, ls, ag, al, trs, atr, ps, ms, ts, sp, sm, st, dx,
         CASE WHEN rn <= 28 AND dx IS NOT NULL THEN pdxs + dx ELSE pdxs END AS dxs,
         CASE WHEN rn < 28 THEN NULL WHEN rn = 28 THEN (pdxs + dx) / 14 ELSE (padx * 13 + dx) / 14 END AS adx
  FROM (
    SELECT *,
      CASE WHEN st IS NULL THEN NULL
           WHEN (CASE WHEN st <> 0 THEN 100.0 * sp / st ELSE CAST(0 AS DOUBLE) END)
              + (CASE WHEN st <> 0 THEN 100.0 * sm / st ELSE CAST(0 AS DOUBLE) END) <> 0
           THEN 100.0 * abs((CASE WHEN st <> 0 THEN 100.0 * sp / st ELSE CAST(0 AS DOUBLE) END)
                          - (CASE WHEN st <> 0 THEN 100.0 * sm / st ELSE CAST(0 AS DOUBLE) END))
                / ((CASE WHEN st <> 0 THEN 100.0 * sp / st ELSE CAST(0 AS DOUBLE) END)
                 + (CASE WHEN st <> 0 THEN 100.0 * sm / st ELSE CAST(0 AS DOUBLE) END))
           ELSE CAST(0 AS DOUBLE) END AS dx
    FROM (
      SELECT x.symbol_id, x.time_frame, x.rn,
        {A12} * x.close + {B12} * r.e12 AS e12,
        {A26} * x.close + {B26} * r.e26 AS e26,
        {A9} * (({A12} * x.close + {B12} * r.e12) - ({A26} * x.close + {B26} * r.e26)) + {B9} * r.sig AS sig,
        CASE WHEN x.rn <= 15 THEN r.gs + x.g ELSE r.gs END AS gs,
        CASE WHEN x.rn <= 15 THEN r.ls + x.lo ELSE r.ls END AS ls,
        CASE WHEN x.rn < 15 THEN NULL WHEN x.rn = 15 THEN (r.gs + x.g) / 14 ELSE (r.ag * 13 + x.g) / 14 END AS ag,
        CASE WHEN x.rn < 15 THEN NULL WHEN x.rn = 15 THEN (r.ls + x.lo) / 14 ELSE (r.al * 13 + x.lo) / 14 END AS al,
        CASE WHEN x.rn <= 14 THEN r.trs + x.tr ELSE r.trs END AS trs,
        CASE WHEN x.rn < 14 THEN NULL WHEN x.rn = 14 THEN (r.trs + x.tr) / 14 ELSE (r.atr * 13 + x.tr) / 14 END AS atr,
        CASE WHEN x.rn <= 15 THEN r.ps + x.pdm ELSE r.ps END AS ps,
        CASE WHEN x.rn <= 15 THEN r.ms + x.mdm ELSE r.ms END AS ms,
        CASE WHEN x.rn <= 15 THEN r.ts + x.tr ELSE r.ts END AS ts,
        CASE WHEN x.rn < 15 THEN NULL WHEN x.rn = 15 THEN (r.ps + x.pdm) / 14 ELSE (r.sp * 13 + x.pdm) / 14 END AS sp,
        CASE WHEN x.rn < 15 THEN NULL WHEN x.rn = 15 THEN (r.ms + x.mdm) / 14 ELSE (r.sm * 13 + x.mdm) / 14 END AS sm,
        CASE WHEN x.rn < 15 THEN NULL WHEN x.rn = 15 THEN (r.ts + x.tr) / 14 ELSE (r.st * 13 + x.tr) / 14 END AS st,
        r.dxs AS pdxs, r.adx AS padx
      FROM rec r JOIN xb x ON x.symbol_id = r.symbol_id AND x.time_frame = r.time_frame AND x.rn = r.rn + 1
    ) q1
  ) q2
),
ri AS (
  SELECT symbol_id, time_frame, rn, e12 AS ema_12, e26 AS ema_26, e12 - e26 AS macd, sig AS macd_signal,
         (e12 - e26) - sig AS macd_histogram,
         CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN CAST(100 AS DOUBLE) ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi_14,
         atr AS atr_14, adx
  FROM rec
)"""


def indicator_sql(cols: list[str], recursive: bool) -> str:
    ctes = "WITH RECURSIVE " if recursive else "WITH "
    body = SERIES_SQL + ("," + REC_SQL if recursive else "")
    sel = ", ".join(cols)
    join = " JOIN ri USING (symbol_id, time_frame, rn)" if recursive else ""
    return f"{ctes}{body.strip()}\nSELECT symbol_id, t_stamp AS timestamp, time_frame, {sel} FROM wd{join}"


def _spark(t: MarketTables, cols: list[str], recursive: bool) -> DataFrame:
    bars = I.series_bars(t.candles)
    win = [c for c in cols if c not in I.RECURRENCE_COLUMNS]
    if not recursive:
        df = I.window_indicators(bars, columns=cols)
    elif win:
        df = I.all_indicators(bars, win, cols)
    else:
        df = I.recurrence_indicators(bars, columns=cols)
    return df.select("symbol_id", F.col("t_stamp").alias("timestamp"), "time_frame", *cols)


def _register(name: str, cols: list[str], recursive: bool, doc: str):
    def fn(t: MarketTables) -> DataFrame:
        return _spark(t, cols, recursive)
    fn.__doc__ = doc
    query(name, indicator_sql(cols, recursive))(fn)


_register("ind_sma", ["sma_5", "sma_10", "sma_20", "sma_50", "sma_200"], False, "I1: simple moving averages.")
_register("ind_stoch", ["stoch_k", "stoch_d", "williams_r"], False, "I5/I12: stochastic %K/%D, Williams %R.")
_register("ind_bollinger", ["bollinger_upper", "bollinger_middle", "bollinger_lower"], False, "I6: Bollinger bands.")
_register("ind_volume", ["volume_sma_20", "obv"], False, "I8/I9: volume SMA and on-balance volume.")
_register("ind_cci", ["cci"], False, "I11: commodity channel index.")
_register("ind_ema", ["ema_12", "ema_26"], True, "I2: exponential moving averages.")
_register("ind_rsi", ["rsi_14"], True, "I3: Wilder RSI.")
_register("ind_macd", ["macd", "macd_signal", "macd_histogram"], True, "I4: MACD line, signal, histogram.")
_register("ind_atr", ["atr_14"], True, "I7: Wilder average true range.")
_register("ind_adx", ["adx"], True, "I10: average directional index.")
_register("indicators_all", list(S.INDICATOR_COLUMNS), True, "I13: all 22 indicator columns per bar.")


_IND_SYM_COLS = ", ".join(f"i.{c}" for c in S.INDICATOR_COLUMNS)


@query("indicators_with_symbols", indicator_sql(list(S.INDICATOR_COLUMNS), True).replace(
    "\nSELECT symbol_id, t_stamp AS timestamp, time_frame, " + ", ".join(S.INDICATOR_COLUMNS)
    + " FROM wd JOIN ri USING (symbol_id, time_frame, rn)",
    ",\nind AS (SELECT symbol_id, t_stamp AS timestamp, time_frame, " + ", ".join(S.INDICATOR_COLUMNS)
    + " FROM wd JOIN ri USING (symbol_id, time_frame, rn))\n"
    + f"SELECT s.symbol, s.name, s.exchange, i.timestamp, i.time_frame, {_IND_SYM_COLS}, "
    + "TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM ind i JOIN symbols_t s ON i.symbol_id = s.id WHERE s.is_active"))
def indicators_with_symbols(t: MarketTables) -> DataFrame:
    """technical_indicators_with_symbols view over the stored indicator table."""
    return J.indicators_with_symbols(t.indicators, t.stored_symbols)


_LEFT_SQL = (
    ",\nind AS (SELECT symbol_id, t_stamp, time_frame, " + ", ".join(["sma_20", "rsi_14", "macd"])
    + " FROM wd JOIN ri USING (symbol_id, time_frame, rn)),\n"
    "every AS (SELECT *, time_frame AS stored_frame FROM ind{more})\n"
    "SELECT s.symbol, c.symbol_id, c.t_stamp AS timestamp, c.time_frame, c.data_source, c.close, i.sma_20, i.rsi_14, i.macd "
    "FROM candles_t c JOIN symbols_t s ON c.symbol_id = s.id "
    "LEFT JOIN every i ON i.symbol_id = c.symbol_id AND i.t_stamp = c.t_stamp{same}")


def _left_sql(more: str, same: str) -> str:
    return indicator_sql(["sma_20", "rsi_14", "macd"], True).replace(
        "\nSELECT symbol_id, t_stamp AS timestamp, time_frame, sma_20, rsi_14, macd FROM wd JOIN ri USING (symbol_id, time_frame, rn)",
        _LEFT_SQL.format(more=more, same=same))


@query("candles_left_indicators", _left_sql("", " AND i.stored_frame = c.time_frame"))
def candles_left_indicators(t: MarketTables) -> DataFrame:
    """Symbols x candles left-join the stored indicators on (symbol, time, time_frame); every feed's
    bar gets the indicator row of its (symbol, time, time frame)."""
    return J.candles_left_indicators(t.candles, t.stored_symbols, t.indicators, columns=["sma_20", "rsi_14", "macd"])


@query("candles_left_indicators_all", _left_sql(" UNION ALL SELECT * REPLACE ('1w' AS time_frame), '1w' AS stored_frame FROM ind WHERE dayofweek(t_stamp) = 1", ""))
def candles_left_indicators_all(t: MarketTables) -> DataFrame:
    """J4 in its documented form, without the time frame: a Monday's bar meets the indicator rows of both
    time frames (the weekly ones stand for Mondays here) and fans out."""
    weekly = t.indicators.filter(F.dayofweek("timestamp") == 2).withColumn("time_frame", F.lit("1w"))
    return J.candles_left_indicators(t.candles, t.stored_symbols, t.indicators.unionByName(weekly), match_time_frame=False,
                                     columns=["sma_20", "rsi_14", "macd"])


HOT_CHUNK = 256
_HOT_COLS = ["sma_200", "bollinger_upper", "stoch_d", "volume_sma_20", "obv", "cci", "ema_26", "macd_histogram", "rsi_14", "atr_14", "adx"]


# Values that pass from chunk to chunk may differ in a double's last digit from those of one pass: four decimals are compared.
@query("ind_hot_series", "SELECT symbol_id, timestamp, time_frame, " + ", ".join(f"round({c}, 4) AS {c}" for c in _HOT_COLS) + " FROM ("
       + indicator_sql(_HOT_COLS, True).replace("FROM candles_t)", """FROM (
      SELECT 0 AS symbol_id, '1d' AS time_frame, t_stamp, 'all' AS data_source, arg_min(open, (symbol_id, data_source)) AS open, max(high) AS high,
             min(low) AS low, arg_max(close, (symbol_id, data_source)) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM candles_t GROUP BY t_stamp))""") + ")")
def ind_hot_series(t: MarketTables) -> DataFrame:
    """I1-I13 on one hot series, the daily bars of the whole market: its chunks are worked on by many tasks."""
    order = F.struct("symbol_id", "data_source")
    day = t.candles.groupBy("t_stamp").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"))
    bars = I.series_bars(day.select(F.lit(0).alias("symbol_id"), F.lit("1d").alias("time_frame"), "t_stamp", F.lit("all").alias("data_source"),
                                    "open", "high", "low", "close", "volume"))
    out = I.all_indicators(bars, [c for c in _HOT_COLS if c in I.WINDOW_COLUMNS], [c for c in _HOT_COLS if c in I.RECURRENCE_COLUMNS], chunk_bars=HOT_CHUNK)
    return out.select("symbol_id", F.col("t_stamp").alias("timestamp"), "time_frame", *[F.round(c, 4).alias(c) for c in _HOT_COLS])


@query("prices_latest_tick", """
SELECT symbol_id, data_source, arg_max(id, (ts, id)) AS id, arg_max(ts, (ts, id)) AS ts,
       arg_max(price, (ts, id)) AS price, arg_max(size, (ts, id)) AS size
FROM ticks_t GROUP BY symbol_id, data_source
""")
def prices_latest_tick(t: MarketTables) -> DataFrame:
    """Newest tick per (symbol, source) by (ts, id)."""
    return I.latest_per_key(t.ticks, ["symbol_id", "data_source"])
