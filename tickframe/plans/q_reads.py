"""Registered reads: symbols, candles, prices."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reads as R
from ..operators import stats as A
from ..sources.catalog import MarketTables
from .oracle import CANDLE_COLS, PRICE_COLS, SYMBOL_COLS, VIEW_CANDLE
from .registry import RANGE_HI, RANGE_LO, SYMBOL, TIME_FRAME, query


def _symbol_id(t: MarketTables) -> int:
    """The id of the point reads' symbol (one scalar), -1 if there is none."""
    sid = R.symbol_id_of(t.symbols, SYMBOL)
    return -1 if sid is None else sid


@query("symbols_page", f"""
SELECT {SYMBOL_COLS} FROM symbols_t ORDER BY symbol, id LIMIT 25 OFFSET 10
""")
def symbols_page(t: MarketTables) -> DataFrame:
    """Second page of symbols by name."""
    return R.symbols_page(t.symbols, limit=25, offset=10)


@query("symbol_lookup", f"""
SELECT {SYMBOL_COLS} FROM symbols_t WHERE symbol = '{SYMBOL}'
""")
def symbol_lookup(t: MarketTables) -> DataFrame:
    """Equality lookup by symbol."""
    return R.symbol_lookup(t.symbols, SYMBOL)


@query("symbols_filtered", f"""
SELECT {SYMBOL_COLS} FROM symbols_t WHERE is_active AND asset_type = 'crypto'
""")
def symbols_filtered(t: MarketTables) -> DataFrame:
    """Active crypto symbols (exchange filter unset)."""
    return R.symbols_filtered(t.symbols, is_active=True, asset_type="crypto")


@query("symbols_of_exchange", f"""
SELECT {SYMBOL_COLS} FROM symbols_t WHERE exchange = 'LSE'
""")
def symbols_of_exchange(t: MarketTables) -> DataFrame:
    """Symbols of one exchange, active or not."""
    return R.symbols_filtered(t.symbols, is_active=None, exchange="LSE")


@query("page_count", """
SELECT count(*) AS returned FROM (SELECT id FROM symbols_t WHERE is_active ORDER BY symbol, id LIMIT 100 OFFSET 50)
""")
def page_count(t: MarketTables) -> DataFrame:
    """The ``count`` of the rows that a page returns."""
    return R.symbols_filtered(t.symbols, is_active=True, limit=100, offset=50).agg(F.count(F.lit(1)).alias("returned"))


@query("symbols_after", f"""
SELECT {SYMBOL_COLS} FROM symbols_t WHERE symbol > '{SYMBOL}' ORDER BY symbol, id LIMIT 25
""")
def symbols_after(t: MarketTables) -> DataFrame:
    """L1 by key: the page after a symbol; its cost does not grow with the page's depth."""
    return R.symbols_after(t.symbols, SYMBOL, limit=25)


@query("page_overlap", """
(SELECT id, symbol FROM symbols_t ORDER BY symbol, id LIMIT 5 OFFSET 0)
INTERSECT
(SELECT id, symbol FROM symbols_t ORDER BY symbol, id LIMIT 5 OFFSET 5)
""")
def page_overlap(t: MarketTables) -> DataFrame:
    """Set op: two consecutive pages share no row (empty result)."""
    p1 = R.symbols_page(t.symbols, 5, 0).select("id", "symbol")
    p2 = R.symbols_page(t.symbols, 5, 5).select("id", "symbol")
    return p1.intersect(p2)


@query("page_overlap_shifted", """
(SELECT id, symbol FROM symbols_t ORDER BY symbol, id LIMIT 6 OFFSET 0)
INTERSECT
(SELECT id, symbol FROM symbols_t ORDER BY symbol, id LIMIT 6 OFFSET 4)
""")
def page_overlap_shifted(t: MarketTables) -> DataFrame:
    """Set op: pages that begin before the last one has ended share its last rows."""
    return R.symbols_page(t.symbols, 6, 0).select("id", "symbol").intersect(R.symbols_page(t.symbols, 6, 4).select("id", "symbol"))


@query("candles_latest", f"""
SELECT md.{CANDLE_COLS.replace(', ', ', md.')}, s.symbol, s.name
FROM candles_t md JOIN symbols_t s ON md.symbol_id = s.id
WHERE s.symbol = '{SYMBOL}' AND md.time_frame = '{TIME_FRAME}'
ORDER BY md.t_stamp DESC, md.data_source, md.id DESC LIMIT 100
""")
def candles_latest(t: MarketTables) -> DataFrame:
    """Latest 100 daily candles of one symbol."""
    return R.candles_latest(t.candles_of(_symbol_id(t)), t.symbols, SYMBOL, TIME_FRAME, limit=100)


@query("candles_range", f"""
SELECT {VIEW_CANDLE}
FROM candles_t md JOIN symbols_t s ON md.symbol_id = s.id
WHERE s.is_active AND md.time_frame = '{TIME_FRAME}'
  AND md.t_stamp >= TIMESTAMP '{RANGE_LO}' AND md.t_stamp <= TIMESTAMP '{RANGE_HI}'
""")
def candles_range(t: MarketTables) -> DataFrame:
    """Every active series, inclusive date range."""
    c = R.time_range(t.candles.filter(F.col("time_frame") == TIME_FRAME), RANGE_LO, RANGE_HI)
    return J.candles_with_symbols(c, t.symbols)


@query("candles_with_symbols", f"""
SELECT {VIEW_CANDLE} FROM candles_t md JOIN symbols_t s ON md.symbol_id = s.id WHERE s.is_active
""")
def candles_with_symbols(t: MarketTables) -> DataFrame:
    """market_data_with_symbols view."""
    return J.candles_with_symbols(t.candles, t.symbols)


@query("candles_latest_per_symbol", f"""
SELECT {CANDLE_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY t_stamp DESC, data_source) AS rn
  FROM candles_t WHERE time_frame = '{TIME_FRAME}') WHERE rn <= 5
""")
def candles_latest_per_symbol(t: MarketTables) -> DataFrame:
    """Latest 5 candles of every series."""
    c = t.candles.filter(F.col("time_frame") == TIME_FRAME)
    return R.latest_n_per_series(c, 5, ["symbol_id"], [F.col("t_stamp").desc(), F.col("data_source")])


@query("prices_latest", f"""
SELECT p.{PRICE_COLS.replace(', ', ', p.')}, s.symbol, s.name, s.exchange, s.asset_type
FROM prices_t p JOIN symbols_t s ON p.symbol_id = s.id
ORDER BY p.last_updated DESC, p.id DESC LIMIT 50
""")
def prices_latest(t: MarketTables) -> DataFrame:
    """Newest 50 prices."""
    return R.prices_latest(J.prices_with_symbols(t.prices, t.symbols), limit=50)


@query("prices_by_symbol", f"""
SELECT p.{PRICE_COLS.replace(', ', ', p.')}, s.symbol, s.name, s.exchange, s.asset_type
FROM prices_t p JOIN symbols_t s ON p.symbol_id = s.id WHERE s.symbol = '{SYMBOL}'
""")
def prices_by_symbol(t: MarketTables) -> DataFrame:
    """Prices of one symbol, all sources (id looked up first, so the filter reaches the scan)."""
    return J.prices_with_symbols(t.prices_of(_symbol_id(t)), t.symbols).filter(F.col("symbol") == SYMBOL)


@query("prices_nullified", f"""
SELECT id, symbol_id, price, nullif(bid, 0) AS bid, nullif(ask, 0) AS ask, nullif(volume_24h, 0) AS volume_24h,
       nullif(change_24h, 0) AS change_24h, nullif(change_percent_24h, 0) AS change_percent_24h,
       nullif(market_cap, 0) AS market_cap, data_source, last_updated, created_at
FROM prices_t
""")
def prices_nullified(t: MarketTables) -> DataFrame:
    """Numeric 0 in optional price fields reads as missing."""
    return R.nullify_optional(t.prices, ["bid", "ask", "volume_24h", "change_24h", "change_percent_24h", "market_cap"])


_LP = ("s.symbol, s.name, s.exchange, s.asset_type, s.currency, p.price, p.bid, p.ask, p.volume_24h, "
       "p.change_24h, p.change_percent_24h, p.market_cap, p.data_source, p.last_updated")


@query("latest_prices", f"""
SELECT {_LP} FROM prices_t p JOIN symbols_t s ON p.symbol_id = s.id WHERE s.is_active
""")
def latest_prices(t: MarketTables) -> DataFrame:
    """latest_prices view."""
    return J.latest_prices(t.prices, t.symbols)


@query("latest_prices_top", f"""
SELECT {_LP} FROM prices_t p JOIN symbols_t s ON p.symbol_id = s.id WHERE s.is_active
ORDER BY p.last_updated DESC, s.symbol, p.data_source LIMIT 10
""")
def latest_prices_top(t: MarketTables) -> DataFrame:
    """Newest 10 rows of the latest_prices view."""
    return (J.latest_prices(t.prices, t.symbols)
            .orderBy(F.col("last_updated").desc(), "symbol", "data_source").limit(10))


@query("symbols_left_prices", """
SELECT s.symbol, s.name, s.exchange, p.price, p.last_updated
FROM symbols_t s LEFT JOIN (SELECT * FROM prices_t WHERE symbol_id % 4 <> 0) p ON s.id = p.symbol_id
WHERE s.is_active
ORDER BY p.last_updated DESC NULLS FIRST, s.symbol, p.data_source LIMIT 10
""")
def symbols_left_prices(t: MarketTables) -> DataFrame:
    """Active symbols left-join prices, newest first with NULLs first, top 10. Prices of
    every fourth symbol are left out, so some symbols have none."""
    j = J.symbols_left_prices(t.symbols, t.prices.filter(F.pmod("symbol_id", F.lit(4)) != 0))
    return (j.orderBy(F.col("last_updated").desc_nulls_first(), "symbol", "data_source").limit(10)
            .select("symbol", "name", "exchange", "price", "last_updated"))


@query("asset_type_stats", """
SELECT s.asset_type, count(*) AS symbol_count, round(avg(p.price), 6) AS avg_price
FROM symbols_t s LEFT JOIN prices_t p ON s.id = p.symbol_id
WHERE s.is_active
GROUP BY s.asset_type
ORDER BY symbol_count DESC, s.asset_type
""")
def asset_type_stats(t: MarketTables) -> DataFrame:
    """Per asset type, joined row count and mean price."""
    return A.asset_type_stats(J.symbols_left_prices(t.symbols, t.prices))


@query("table_counts", """
SELECT 'symbols' AS table_name, count(*) AS row_count FROM symbols_t
UNION ALL SELECT 'market_data', count(*) FROM candles_t
UNION ALL SELECT 'real_time_prices', count(*) FROM prices_t
UNION ALL SELECT 'market_sessions', count(*) FROM sessions_t
UNION ALL SELECT 'data_sources', count(*) FROM sources_t
""")
def table_counts(t: MarketTables) -> DataFrame:
    """COUNT(*) of each table."""
    return A.table_counts({"symbols": t.symbols, "market_data": t.candles, "real_time_prices": t.prices,
                           "market_sessions": t.sessions, "data_sources": t.data_sources})


@query("resolve_symbols", """
SELECT tk.id, 'Supplier#' || lpad(CAST(tk.symbol_id AS VARCHAR), 9, '0') AS symbol, s.id AS symbol_id,
       tk.ts, tk.price, tk.data_source
FROM ticks_t tk LEFT JOIN symbols_t s ON s.symbol = 'Supplier#' || lpad(CAST(tk.symbol_id AS VARCHAR), 9, '0')
""")
def resolve_symbols(t: MarketTables) -> DataFrame:
    """Resolve the symbol text of every incoming tick to an id in one join."""
    from ..sources.tables import tick_symbol_text

    inc = t.ticks.select("id", tick_symbol_text(F.col("symbol_id")).alias("symbol"), "ts", "price", "data_source")
    return J.resolve_symbols(inc, t.symbols).select("id", "symbol", "symbol_id", "ts", "price", "data_source")


@query("unresolved_symbols", """
SELECT tk.id, 'Supplier#' || lpad(CAST(tk.symbol_id AS VARCHAR), 9, '0') AS symbol, tk.ts, tk.price, tk.data_source
FROM ticks_t tk
WHERE NOT EXISTS (SELECT 1 FROM symbols_t s WHERE s.symbol = 'Supplier#' || lpad(CAST(tk.symbol_id AS VARCHAR), 9, '0'))
""")
def unresolved_symbols(t: MarketTables) -> DataFrame:
    """Incoming ticks whose symbol is unknown (quarantine)."""
    from ..sources.tables import tick_symbol_text

    inc = t.ticks.select("id", tick_symbol_text(F.col("symbol_id")).alias("symbol"), "ts", "price", "data_source")
    return J.unresolved_symbols(inc, t.symbols)


@query("cascade_delete", """
WITH gone AS (SELECT id FROM symbols_t WHERE exchange = 'TSE')
SELECT 'symbols' AS table_name, count(*) AS row_count FROM symbols_t WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'market_data', count(*) FROM candles_t WHERE symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'real_time_prices', count(*) FROM prices_t WHERE symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'technical_indicators', count(DISTINCT (symbol_id, t_stamp, time_frame)) FROM candles_t WHERE symbol_id NOT IN (SELECT id FROM gone)
""")
def cascade_delete(t: MarketTables) -> DataFrame:
    """Delete the symbols of one exchange; children follow (ON DELETE CASCADE)."""
    from ..operators import merge as M

    tables = M.delete_symbols(t.symbols, F.col("exchange") == "TSE", candles=t.candles, prices=t.prices,
                              indicators=t.indicators)
    return A.table_counts({"symbols": tables["symbols"], "market_data": tables["candles"],
                           "real_time_prices": tables["prices"], "technical_indicators": tables["indicators"]})


@query("timeframes_by_symbol", """
SELECT DISTINCT s.symbol, c.time_frame
FROM (SELECT symbol_id, CASE month(t_stamp) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1w' ELSE time_frame END AS time_frame
      FROM candles_t) c JOIN symbols_t s ON c.symbol_id = s.id
WHERE c.time_frame IS NOT NULL AND c.time_frame <> ''
""")
def timeframes_by_symbol(t: MarketTables) -> DataFrame:
    """Distinct time frames per symbol."""
    k = F.pmod(F.month("t_stamp"), F.lit(4))
    frames = F.when(k == 1, "").when(k == 2, "1w").when(k == 3, F.col("time_frame"))  # k = 0: NULL
    return R.timeframes_by_symbol(t.candles.withColumn("time_frame", frames), t.symbols)


@query("candles_stored_range", f"""
SELECT symbol_id, t_stamp, CAST(open AS DECIMAL(20, 8)) AS open, CAST(close AS DECIMAL(20, 8)) AS close, volume,
       time_frame, data_source, strftime(t_stamp, '%Y-%m') AS year_month
FROM candles_t
WHERE time_frame = '{TIME_FRAME}' AND t_stamp >= TIMESTAMP '{RANGE_LO}' AND t_stamp <= TIMESTAMP '{RANGE_HI}'
""")
def candles_stored_range(t: MarketTables) -> DataFrame:
    """Candles written as the partitioned table (time_frame, year_month; decimal
    storage types) and read back with an inclusive range: the scan prunes to the months in
    range (PartitionFilters) and pushes the timestamp bounds (PushedFilters)."""
    from ..operators import merge as M
    from ..session import fresh_path

    path = M.write_candles(t.candles, fresh_path(t.spark, "market_data"))
    stored = M.read_candles(t.spark, path).filter(F.col("time_frame") == TIME_FRAME)
    return R.time_range(stored, RANGE_LO, RANGE_HI).select(
        "symbol_id", "t_stamp", "open", "close", "volume", "time_frame", "data_source", "year_month")
