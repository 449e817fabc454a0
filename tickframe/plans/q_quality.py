"""Registered data-quality and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import quality as Q
from ..operators import sessions as SS
from ..session import PARQUET, fresh_path, scratch
from ..sources.catalog import MarketTables
from .registry import query


STATUS_NOW = "2024-02-01 00:00:00"
# Rows that break each rule, by key, so that every check has something to find.
_BAD_CANDLES_SQL = """(SELECT * REPLACE (CASE WHEN symbol_id % 7 = 0 THEN -open ELSE open END AS open, CASE WHEN symbol_id % 11 = 0 THEN 0 ELSE high END AS high,
  CASE WHEN symbol_id % 13 = 0 THEN NULL ELSE low END AS low, CASE WHEN symbol_id % 17 = 0 THEN -1.0 ELSE close END AS close,
  CASE WHEN symbol_id % 19 = 0 THEN -1 ELSE volume END AS volume, CASE WHEN symbol_id % 23 = 0 THEN '2d' ELSE time_frame END AS time_frame) FROM candles_t)"""
_BAD_PRICES_SQL = "(SELECT * REPLACE (CASE symbol_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -price ELSE price END AS price) FROM prices_t)"
_BAD_SYMBOLS_SQL = ("(SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN NULL ELSE exchange END AS exchange, "
                    "CASE WHEN id % 8 = 0 THEN repeat(name, 20) ELSE name END AS name) FROM symbols_t)")


def _bad_candles(t: MarketTables) -> DataFrame:
    at = lambda n: F.pmod("symbol_id", F.lit(n)) == 0
    return t.candles.withColumns({
        "open": F.when(at(7), -F.col("open")).otherwise(F.col("open")), "high": F.when(at(11), 0.0).otherwise(F.col("high")),
        "low": F.when(~at(13), F.col("low")), "close": F.when(at(17), -1.0).otherwise(F.col("close")),
        "volume": F.when(at(19), -1).otherwise(F.col("volume")), "time_frame": F.when(at(23), "2d").otherwise(F.col("time_frame"))})


def _bad_prices(t: MarketTables) -> DataFrame:
    k = F.pmod("symbol_id", F.lit(3))
    return t.prices.withColumn("price", F.when(k == 1, -F.col("price")).when(k == 2, F.col("price")))


def _bad_symbols(t: MarketTables) -> DataFrame:
    return t.symbols.withColumns({"exchange": F.when(F.pmod("id", F.lit(6)) != 0, F.col("exchange")),
                                  "name": F.when(F.pmod("id", F.lit(8)) == 0, F.repeat("name", 20)).otherwise(F.col("name"))})


def _twice(df: DataFrame, key: str) -> DataFrame:
    return df.unionByName(df.filter(F.pmod(key, F.lit(5)) == 0))


def _nulls_sql(table: str, cte: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM {cte}"
        for c in cols)


# Tables without fault-bearing rows of their own: one column of some rows is emptied.
_OTHERS = {"technical_indicators": ("(SELECT symbol_id, CASE WHEN symbol_id % 9 <> 0 THEN t_stamp END AS timestamp, time_frame FROM (SELECT DISTINCT symbol_id, t_stamp, time_frame FROM candles_t))"),
           "market_sessions": "(SELECT * REPLACE (CASE WHEN exchange <> 'LSE' THEN timezone END AS timezone) FROM sessions_t WHERE exchange IN (SELECT exchange FROM symbols_t))",
           "market_status": "(SELECT exchange, CASE WHEN exchange <> 'TSE' THEN true END AS is_open FROM symbols_t GROUP BY exchange)",
           "data_sources": "(SELECT data_source AS name, CASE WHEN data_source <> 'feed_a' THEN 'https://' || data_source END AS base_url FROM candles_t GROUP BY data_source)"}


def _others(t: MarketTables) -> dict[str, DataFrame]:
    listed = t.symbols.select("exchange").distinct()
    return {"technical_indicators": t.indicators.withColumn("timestamp", F.when(F.pmod("symbol_id", F.lit(9)) != 0, F.col("timestamp"))),
            "market_sessions": t.sessions.join(listed, "exchange", "left_semi").withColumn("timezone", F.when(F.col("exchange") != "LSE", F.col("timezone"))),
            "market_status": listed.withColumn("is_open", F.when(F.col("exchange") != "TSE", True)),
            "data_sources": t.candles.select(F.col("data_source").alias("name")).distinct().withColumn(
                "base_url", F.when(F.col("name") != "feed_a", F.concat(F.lit("https://"), "name")))}


_ALL_SQL = {"symbols": _BAD_SYMBOLS_SQL, "market_data": _BAD_CANDLES_SQL, "real_time_prices": _BAD_PRICES_SQL, **_OTHERS}


@query("dq_nulls", "\nUNION ALL ".join(_nulls_sql(name, sql, S.NOT_NULL[name]) for name, sql in _ALL_SQL.items()))
def dq_nulls(t: MarketTables) -> DataFrame:
    """Q1: NULL counts of every NOT NULL column of all seven tables."""
    t.store_candles()
    tables = {"symbols": _bad_symbols(t), "market_data": _bad_candles(t), "real_time_prices": _bad_prices(t), **_others(t)}
    return Q.union_all([Q.null_counts(df, name, S.NOT_NULL[name]) for name, df in tables.items()])


def _dup_sql(table: str, cte: str, key: list[str]) -> str:
    k = ", ".join(key)
    return (f"SELECT '{table}' AS table_name, '{','.join(key)}' AS key_columns, count(*) AS duplicate_keys, "
            f"CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows "
            f"FROM (SELECT {k}, count(*) AS n FROM {cte} GROUP BY {k} HAVING count(*) > 1)")


_TWICE = {cte: f"(SELECT * FROM {cte} UNION ALL SELECT * FROM {cte} WHERE {key} % 5 = 0)"
          for cte, key in [("symbols_t", "id"), ("candles_t", "symbol_id"), ("prices_t", "symbol_id")]}
_DUPS = [("symbols", "symbols_t", ["id"]), ("symbols", "symbols_t", ["symbol"]),
         ("market_data", "candles_t", S.KEYS["market_data"][0]),
         ("real_time_prices", "prices_t", S.KEYS["real_time_prices"][0]),
         ("technical_indicators", "indicators_t", S.KEYS["technical_indicators"][0])]
_TWICE["indicators_t"] = "(SELECT DISTINCT symbol_id, t_stamp AS timestamp, time_frame FROM candles_t)"


@query("dq_unique", "\nUNION ALL ".join(_dup_sql(name, _TWICE[cte], key) for name, cte, key in _DUPS))
def dq_unique(t: MarketTables) -> DataFrame:
    """Q2: duplicate keys per declared UNIQUE/PRIMARY KEY."""
    t.store_candles()
    tables = {"symbols_t": _twice(t.symbols, "id"), "candles_t": _twice(t.candles, "symbol_id"), "prices_t": _twice(t.prices, "symbol_id"),
              "indicators_t": t.indicators}
    return Q.union_all([Q.key_duplicates(tables[cte], name, key) for name, cte, key in _DUPS])


@query("dq_orphans", """
SELECT 'market_data' AS table_name, count(*) AS orphan_rows FROM candles_t WHERE symbol_id NOT IN (SELECT id FROM symbols_t)
UNION ALL SELECT 'real_time_prices', count(*) FROM prices_t WHERE symbol_id NOT IN (SELECT id FROM symbols_t)
UNION ALL SELECT 'ticks', count(*) FROM ticks_t WHERE symbol_id NOT IN (SELECT id FROM symbols_t)
UNION ALL SELECT 'technical_indicators', count(DISTINCT (symbol_id, t_stamp, time_frame)) FROM candles_t
          WHERE symbol_id NOT IN (SELECT id FROM symbols_t WHERE id % 4 <> 0)
""")
def dq_orphans(t: MarketTables) -> DataFrame:
    """Q3: rows referencing a missing symbol (foreign keys)."""
    return Q.union_all([Q.orphans(t.candles, "market_data", t.symbols),
                        Q.orphans(t.prices, "real_time_prices", t.symbols),
                        Q.orphans(t.ticks, "ticks", t.symbols),
                        # against a symbols table that lacks every fourth symbol
                        Q.orphans(t.indicators, "technical_indicators",
                                  t.symbols.filter(F.pmod("id", F.lit(4)) != 0))])


@query("dq_ranges", f"""
SELECT 'market_data' AS table_name, 'open_not_positive' AS rule, CAST(count_if(NOT coalesce(open > 0, false)) AS BIGINT) AS violations FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'market_data', 'high_not_positive', CAST(count_if(NOT coalesce(high > 0, false)) AS BIGINT) FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'market_data', 'low_not_positive', CAST(count_if(NOT coalesce(low > 0, false)) AS BIGINT) FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'market_data', 'close_not_positive', CAST(count_if(NOT coalesce(close > 0, false)) AS BIGINT) FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'market_data', 'volume_negative', CAST(count_if(NOT coalesce(volume >= 0, false)) AS BIGINT) FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'market_data', 'bad_time_frame', CAST(count_if(NOT coalesce(regexp_full_match(time_frame, '{S.TIMEFRAME_PATTERN[1:-1]}'), false)) AS BIGINT) FROM {_BAD_CANDLES_SQL}
UNION ALL SELECT 'real_time_prices', 'price_not_positive', CAST(count_if(NOT coalesce(price > 0, false)) AS BIGINT) FROM {_BAD_PRICES_SQL}
""")
def dq_ranges(t: MarketTables) -> DataFrame:
    """Value-rule violations per rule."""
    return Q.range_violations(_bad_candles(t), _bad_prices(t))


@query("dq_lengths", "\nUNION ALL ".join(
    f"SELECT 'symbols' AS table_name, '{c}' AS column_name, {n} AS max_length, CAST(count_if(length({c}) > {n}) AS BIGINT) AS too_long FROM {_BAD_SYMBOLS_SQL}"
    for c, n in S.SYMBOL_LENGTHS.items()))
def dq_lengths(t: MarketTables) -> DataFrame:
    """Q5: VARCHAR(n) limits of the symbols table."""
    return Q.length_violations(_bad_symbols(t))


@query("dq_gaps", """
WITH c AS (SELECT symbol_id, data_source, time_frame, t_stamp FROM candles_t
           UNION ALL SELECT symbol_id, data_source, '1M', date_trunc('month', t_stamp) FROM candles_t WHERE month(t_stamp) % 3 <> 0),
g AS (SELECT symbol_id, data_source, time_frame, min(t_stamp) AS first_ts, max(t_stamp) AS last_ts, count(DISTINCT t_stamp) AS present
      FROM c GROUP BY symbol_id, data_source, time_frame),
e AS (SELECT *, CASE WHEN time_frame = '1M' THEN date_diff('month', first_ts, last_ts)
                     ELSE CAST(floor((epoch(last_ts) - epoch(first_ts)) / (1440 * 60)) AS BIGINT) END + 1 AS expected FROM g)
SELECT symbol_id, data_source, time_frame, first_ts, last_ts, expected, present, expected - present AS missing FROM e
""")
def dq_gaps(t: MarketTables) -> DataFrame:
    """Q7: expected vs present bars per series."""
    monthly = (t.candles.filter(F.pmod(F.month("t_stamp"), F.lit(3)) != 0)
               .withColumn("t_stamp", F.date_trunc("month", "t_stamp")).withColumn("time_frame", F.lit("1M")))
    return Q.gap_summary(t.candles.unionByName(monthly))


_BIG_BARS_SQL = """(SELECT DISTINCT symbol_id, data_source, '1w' AS time_frame, date_trunc('week', t_stamp) AS t_stamp FROM candles_t
  UNION ALL SELECT DISTINCT symbol_id, data_source, '1M', date_trunc('month', t_stamp) FROM candles_t WHERE month(t_stamp) % 3 <> 0)"""


@query("missing_bars", f"""
WITH b AS (SELECT *, lead(t_stamp) OVER (PARTITION BY symbol_id, data_source, time_frame ORDER BY t_stamp) AS nxt FROM {_BIG_BARS_SQL})
SELECT symbol_id, data_source, time_frame, CAST(unnest(generate_series(t_stamp + INTERVAL 7 DAY, nxt - INTERVAL 1 DAY, INTERVAL 7 DAY)) AS TIMESTAMP) AS t_stamp
FROM b WHERE time_frame = '1w' AND nxt IS NOT NULL
UNION ALL
SELECT symbol_id, data_source, time_frame, CAST(unnest(generate_series(t_stamp + INTERVAL 1 MONTH, nxt - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS TIMESTAMP)
FROM b WHERE time_frame = '1M' AND nxt IS NOT NULL
""")
def missing_bars(t: MarketTables) -> DataFrame:
    """Q7: the weeks and months without a bar between the first and the last one of each series."""
    weekly = t.candles.select("symbol_id", "data_source", F.lit("1w").alias("time_frame"), F.date_trunc("week", "t_stamp").alias("t_stamp"))
    monthly = t.candles.filter(F.pmod(F.month("t_stamp"), F.lit(3)) != 0).select(
        "symbol_id", "data_source", F.lit("1M").alias("time_frame"), F.date_trunc("month", "t_stamp").alias("t_stamp"))
    # the time frames share no row, so each is made distinct by itself: that merges with the candles' own grouping
    return Q.missing_bars(weekly.distinct().unionByName(monthly.distinct()))


def _rules_sql(table: str, sql: str) -> str:
    """(rule, violations) of one table, as ``write_checked`` measures them."""
    bad = {f"{c}_missing": f"{c} IS NULL" for c in S.NOT_NULL[table]}
    if table == "market_data":
        bad |= {f"{c}_not_positive": f"NOT coalesce({c} > 0, false)" for c in ("open", "high", "low", "close")}
        bad |= {"volume_negative": "NOT coalesce(volume >= 0, false)", "bad_time_frame": f"NOT coalesce(regexp_full_match(time_frame, '{S.TIMEFRAME_PATTERN[1:-1]}'), false)"}
    if table == "real_time_prices":
        bad["price_not_positive"] = "NOT coalesce(price > 0, false)"
    if table == "symbols":
        bad |= {f"{c}_too_long": f"length({c}) > {n}" for c, n in S.SYMBOL_LENGTHS.items()}
    parts = [f"SELECT '{table}' AS table_name, '{r}' AS rule, CAST(count_if({cond}) AS BIGINT) AS violations FROM {sql}" for r, cond in bad.items()]
    if table in S.KEYS:
        key = ", ".join(S.KEYS[table][-1])
        parts.append(f"SELECT '{table}', 'duplicate_keys_dropped', (SELECT count(*) FROM {sql}) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {sql}))")
    return "\nUNION ALL ".join(parts)


@query("dq_on_write", "\nUNION ALL ".join(_rules_sql(name, sql) for name, sql in _ALL_SQL.items()))
def dq_on_write(t: MarketTables) -> DataFrame:
    """Q1, Q2, Q4, Q5: all seven tables written, their constraints measured by the writing jobs."""
    t.store_candles()
    t.store_prices()
    write = lambda name, df: df.write.options(**PARQUET).parquet(fresh_path(t.spark, f"checked-{name}"))
    with scratch(t.spark):  # of the two copies of the indicator table only the checked one is kept
        others = _others(t)
        indicators = Q.write_checked(t.spark, {"technical_indicators": others.pop("technical_indicators")}, write)
    tables = {"symbols": _bad_symbols(t), "market_data": _bad_candles(t), "real_time_prices": _bad_prices(t), **others}
    return indicators.unionByName(Q.write_checked(t.spark, tables, write))


_SOD = "(hour({x}) * 3600 + minute({x}) * 60 + second({x}))"
_SOD_TXT = ("(CAST(split_part({x}, ':', 1) AS INTEGER) * 3600 + CAST(split_part({x}, ':', 2) AS INTEGER) * 60 "
            "+ CAST(split_part({x}, ':', 3) AS INTEGER))")


@query("ticks_in_session", f"""
SELECT tk.id, tk.symbol_id, s.exchange, tk.ts,
       strftime(timezone(se.timezone, CAST(tk.ts AS TIMESTAMPTZ)), '%H:%M:%S') AS local_time,
       {_SOD.format(x="timezone(se.timezone, CAST(tk.ts AS TIMESTAMPTZ))")} >= {_SOD_TXT.format(x="se.open_time")}
       AND {_SOD.format(x="timezone(se.timezone, CAST(tk.ts AS TIMESTAMPTZ))")} <= {_SOD_TXT.format(x="se.close_time")} AS in_session
FROM ticks_t tk JOIN symbols_t s ON tk.symbol_id = s.id JOIN sessions_t se ON se.exchange = s.exchange
WHERE se.is_active
""")
def ticks_in_session(t: MarketTables) -> DataFrame:
    """Ticks with exchange-local time and an in-session flag."""
    return SS.ticks_in_session(t.ticks, t.symbols, t.sessions)


def _status_sql(src: str) -> str:
    lt = "timezone(se.timezone, CAST(a.as_of AS TIMESTAMPTZ))"
    sod = _SOD.format(x=lt)
    o, c = _SOD_TXT.format(x="se.open_time"), _SOD_TXT.format(x="se.close_time")
    at = lambda day, tm: f"CAST(timezone(se.timezone, CAST({day} AS DATE) + CAST({tm} AS TIME)) AS TIMESTAMP)"
    day, nxt = f"CAST({lt} AS DATE)", f"(CAST({lt} AS DATE) + 1)"
    return f"""
SELECT a.exchange, a.as_of, ({sod} >= {o} AND {sod} <= {c}) AS is_open,
       CASE WHEN {sod} < {o} THEN {at(day, 'se.open_time')} ELSE {at(nxt, 'se.open_time')} END AS next_open,
       CASE WHEN {sod} <= {c} THEN {at(day, 'se.close_time')} ELSE {at(nxt, 'se.close_time')} END AS next_close
FROM ({src}) a JOIN sessions_t se ON se.exchange = a.exchange WHERE se.is_active"""


_ACTIVITY = "SELECT DISTINCT s.exchange, date_trunc('hour', tk.ts) AS as_of FROM ticks_t tk JOIN symbols_t s ON tk.symbol_id = s.id"


@query("status_from_sessions", _status_sql(_ACTIVITY))
def status_from_sessions(t: MarketTables) -> DataFrame:
    """Q6: is_open / next_open / next_close of each exchange at every hour its symbols traded."""
    act = SS.exchange_activity(t.ticks, t.symbols).select(
        "exchange", F.date_trunc("hour", "ts").alias("as_of")).distinct()
    return SS.status_at(act, t.sessions)


@query("market_status", f"""
SELECT exchange, is_open, next_open, next_close, as_of AS last_updated FROM ({_status_sql(
    "SELECT s.exchange, max(tk.ts) AS as_of FROM ticks_t tk JOIN symbols_t s ON tk.symbol_id = s.id GROUP BY s.exchange")})
ORDER BY exchange
""")
def market_status(t: MarketTables) -> DataFrame:
    """Each exchange's status as of its latest tick, ordered by exchange."""
    return SS.market_status(t.ticks, t.symbols, t.sessions)


_SEED_STATUS_SQL = ", ".join(f"('{e}', {str(o).lower()}, {'NULL' if h is None else h * 60}, {'NULL' if h is None else (h + w) * 60})"
                             for e, o, h, w in S.SEED_MARKET_STATUS)
_STORED_STATUS = f"""
WITH derived AS (SELECT exchange, is_open, next_open, next_close, as_of AS last_updated FROM ({_status_sql(
    "SELECT s.exchange, max(tk.ts) AS as_of FROM ticks_t tk JOIN symbols_t s ON tk.symbol_id = s.id WHERE s.id % 7 <> 0 GROUP BY s.exchange")})),
seeds AS (SELECT exchange, is_open, TIMESTAMP '{STATUS_NOW}' + to_minutes(CAST(o AS BIGINT)) AS next_open,
                 TIMESTAMP '{STATUS_NOW}' + to_minutes(CAST(c AS BIGINT)) AS next_close, TIMESTAMP '{STATUS_NOW}' AS last_updated
          FROM (VALUES {_SEED_STATUS_SQL}) AS v(exchange, is_open, o, c))
SELECT * FROM (SELECT * FROM derived UNION ALL SELECT * FROM seeds WHERE exchange NOT IN (SELECT exchange FROM derived))"""


def _stored_status(t: MarketTables) -> DataFrame:
    """The market_status table: statuses known from ticks, then the seed rows where there is none."""
    from ..operators import merge as M
    from ..session import fresh_path
    from ..sources.tables import seed_market_status

    known = SS.market_status(t.ticks, t.symbols.filter(F.pmod("id", F.lit(7)) != 0), t.sessions)
    seeds = seed_market_status(t.spark, F.lit(STATUS_NOW).cast("timestamp"))
    path = M.publish(M.insert_ignore_table(known, seeds, ["exchange"], ["exchange"]), fresh_path(t.spark, "market_status"))
    return t.spark.read.schema(S.MARKET_STATUS).parquet(path)


@query("market_status_stored", _STORED_STATUS)
def market_status_stored(t: MarketTables) -> DataFrame:
    """Scan of the stored market_status table, ordered by exchange."""
    return _stored_status(t).orderBy("exchange")


@query("market_status_exchange", _STORED_STATUS + " WHERE exchange = 'XETRA'")
def market_status_exchange(t: MarketTables) -> DataFrame:
    """One exchange of the stored market_status table."""
    return _stored_status(t).filter(F.col("exchange") == "XETRA")


@query("market_status_traded", _STORED_STATUS + " WHERE exchange = 'NYSE'")
def market_status_traded(t: MarketTables) -> DataFrame:
    """One exchange whose stored status comes from its ticks."""
    return _stored_status(t).filter(F.col("exchange") == "NYSE")
