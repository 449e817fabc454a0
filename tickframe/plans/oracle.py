"""DuckDB formulations of the registered queries (independent oracle).

Each query is the same adapters written as SQL CTEs followed by plain SQL, so the Spark
plans can be checked against a second engine on the same Parquet files.
"""

from __future__ import annotations

from .. import schemas as S
from ..sources.tables import TYPED_PAIRS


def _list(vals) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


ADAPTERS = f"""
symbols_t AS (
  SELECT CAST(s.s_suppkey AS INTEGER) AS id, s.s_name AS symbol, concat_ws(' ', s.s_name, n.n_name) AS name,
         ({_list(S.SESSION_EXCHANGES)})[(s.s_nationkey % {len(S.SESSION_EXCHANGES)}) + 1] AS exchange,
         ({_list(S.ASSET_TYPES)})[(r.r_regionkey % {len(S.ASSET_TYPES)}) + 1] AS asset_type,
         'USD' AS currency, r.r_name AS sector, n.n_name AS industry,
         CAST(round(s.s_acctbal * 100) AS BIGINT) AS market_cap,
         (s.s_suppkey % 10) <> 0 AS is_active,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
bars_t AS (
  SELECT l_suppkey, l_shipdate, l_returnflag,
         arg_min(px, (l_orderkey, l_linenumber, l_partkey, px)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, (l_orderkey, l_linenumber, l_partkey, px)) AS close, sum(l_quantity) AS qty
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY l_suppkey, l_shipdate, l_returnflag
),
candles_t AS (
  SELECT ((l_suppkey * 100000 + (CAST(l_shipdate AS DATE) - DATE '1970-01-01')) * 256 + ascii(l_returnflag)) AS id,
         CAST(l_suppkey AS INTEGER) AS symbol_id, CAST(l_shipdate AS TIMESTAMP) AS t_stamp,
         open, high, low, close, CAST(round_even(qty, 0) AS BIGINT) AS volume, close AS adjusted_close,
         '1d' AS time_frame, 'feed_' || lower(l_returnflag) AS data_source,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM bars_t
),
ticks_t AS (
  SELECT event_id AS id, CAST(user_id AS INTEGER) AS symbol_id, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_type AS data_source
  FROM events
),
prices_t AS (
  SELECT id, symbol_id, price, price * 0.999 AS bid, price * 1.001 AS ask, CAST(vol AS BIGINT) AS volume_24h,
         price - first_price AS change_24h,
         CASE WHEN first_price > 0 THEN (price - first_price) / first_price * 100 END AS change_percent_24h,
         CAST(NULL AS BIGINT) AS market_cap, data_source, last_updated, created_at
  FROM (SELECT symbol_id, data_source, arg_max(id, (ts, id)) AS id, arg_max(price, (ts, id)) AS price,
               arg_min(price, (ts, id)) AS first_price, sum(size) AS vol, max(ts) AS last_updated,
               min(ts) AS created_at
        FROM ticks_t WHERE symbol_id IN (SELECT id FROM symbols_t) GROUP BY symbol_id, data_source)
),
pairs_t AS (
  SELECT coalesce(({_list(S.PAIR_SYMBOL_MAP)})[p_partkey], upper(split_part(p_name, ' ', 1)) || upper(substr(p_type, 1, 3)) || CAST(p_partkey AS VARCHAR)) AS pair,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE upper(split_part(p_name, ' ', 1)) || '/' || upper(substr(p_type, 1, 3)) END AS wsname,
         CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS altname,
         CASE WHEN p_partkey % 17 <> 0 THEN upper(split_part(p_name, ' ', 1)) END AS base, p_type AS quote,
         CASE WHEN p_partkey % 19 <> 0 THEN ({_list(S.PAIR_STATUSES)})[(p_size % 4) + 1] END AS status
  FROM part
),
requests_t AS (
  SELECT CASE length(pair) % 3
           WHEN 0 THEN lower(substr(pair, 1, 3) || '/' || substr(pair, 4))
           WHEN 1 THEN substr(pair, 1, 2) || '-' || substr(pair, 3)
           ELSE pair || '-z' END AS requested
  FROM pairs_t
  UNION ALL
  SELECT ({_list(TYPED_PAIRS)})[CAST((p_partkey // 25) % {len(TYPED_PAIRS)} AS INTEGER) + 1] FROM part WHERE p_partkey % 25 = 0
),
sessions_t AS (
  SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{e}', '{n}', '{tz}', '{o}', '{c}', {str(a).lower()})" for i, (e, n, tz, o, c, a) in enumerate(S.SEED_SESSIONS))})
    AS t(id, exchange, session_name, timezone, open_time, close_time, is_active)
),
sources_t AS (
  SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{n}', '{u}', {r}, {str(a).lower()})" for i, (n, u, r, a) in enumerate(S.SEED_DATA_SOURCES))})
    AS t(id, name, base_url, rate_limit_per_minute, is_active)
)"""


def with_adapters(sql: str) -> str:
    """Prefix the adapter CTEs; a query's own leading WITH joins the same CTE list."""
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ADAPTERS.strip() + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ADAPTERS.strip() + ",\n" + body[5:]
    return "WITH " + ADAPTERS.strip() + "\n" + body


CANDLE_COLS = "id, symbol_id, t_stamp, open, high, low, close, volume, adjusted_close, time_frame, data_source, created_at"
SYMBOL_COLS = "id, symbol, name, exchange, asset_type, currency, sector, industry, market_cap, is_active, created_at, updated_at"
PRICE_COLS = ("id, symbol_id, price, bid, ask, volume_24h, change_24h, change_percent_24h, market_cap, "
              "data_source, last_updated, created_at")
VIEW_CANDLE = ("s.symbol, s.name, s.exchange, s.asset_type, md.t_stamp AS timestamp, md.open, md.high, md.low, "
               "md.close, md.volume, md.adjusted_close, md.time_frame, md.data_source, md.created_at")
