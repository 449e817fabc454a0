"""Registered writes and merges.

Merges return the resulting table (or the rows they change) as a DataFrame; the oracle
states the same result as UNION ALL + anti join / row_number in SQL. Scenario: the target
holds the even-day (or even-id) half of a table and the incoming batch carries every key
plus conflicting copies, so each branch of a merge is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import pairs as FP
from ..functions import payload as PL
from ..operators import merge as M
from ..session import PARQUET, discard, fresh_path, scratch, staging_path
from ..sources import payloads as SP
from ..sources.catalog import MarketTables
from .oracle import CANDLE_COLS, PRICE_COLS
from .q_pairs import _NORM_SQL, _OHLC_PAIR_SQL, _infer_sql, _ohlc_pair
from .registry import query

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _days(c: str = "t_stamp"):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))


def _candle_scenario(t: MarketTables) -> tuple[DataFrame, DataFrame]:
    target = t.candles.filter(F.pmod(_days(), F.lit(2)) == 0)
    dups = (t.candles.filter((F.pmod("symbol_id", F.lit(3)) == 0) & (F.pmod(_days(), F.lit(2)) == 1))
            .withColumn("close", F.col("close") + 1.0).withColumn("id", F.col("id") - 1))
    return target, t.candles.unionByName(dups)


_DAYS_SQL = "(CAST(t_stamp AS DATE) - DATE '1970-01-01')"
_CANDLE_SCENARIO_SQL = f"""
WITH tgt AS (SELECT * FROM candles_t WHERE {_DAYS_SQL} % 2 = 0),
inc AS (SELECT * FROM candles_t
        UNION ALL
        SELECT id - 1 AS id, symbol_id, t_stamp, open, high, low, close + 1.0 AS close, volume, adjusted_close,
               time_frame, data_source, created_at
        FROM candles_t WHERE symbol_id % 3 = 0 AND {_DAYS_SQL} % 2 = 1),
firsts AS (SELECT * EXCLUDE (rn) FROM (
             SELECT *, row_number() OVER (PARTITION BY symbol_id, t_stamp, time_frame, data_source ORDER BY id) AS rn
             FROM inc) WHERE rn = 1),
appended AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (
             SELECT 1 FROM tgt t WHERE t.symbol_id = f.symbol_id AND t.t_stamp = f.t_stamp
               AND t.time_frame = f.time_frame AND t.data_source = f.data_source))"""


@query("candles_merge", _CANDLE_SCENARIO_SQL + f"""
SELECT {CANDLE_COLS} FROM tgt UNION ALL SELECT {CANDLE_COLS} FROM appended
""")
def candles_merge(t: MarketTables) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING on the 4-column candle key; first arrival wins."""
    target, incoming = _candle_scenario(t)
    return M.insert_ignore_table(target, incoming, M.CANDLE_KEY, ["id"])


@query("merge_metrics", _CANDLE_SCENARIO_SQL + """
SELECT 'fetched' AS metric, count(*) AS value FROM inc
UNION ALL SELECT 'unique_keys', count(*) FROM firsts
UNION ALL SELECT 'inserted', count(*) FROM appended
""")
def merge_metrics(t: MarketTables) -> DataFrame:
    """A5: fetched / unique / inserted counts of a candle merge."""
    target, incoming = _candle_scenario(t)
    return M.merge_counts(target, incoming, M.CANDLE_KEY)


_UPS_FIELDS = ", ".join(f"CASE WHEN i.id IS NOT NULL THEN i.{c} ELSE t.{c} END AS {c}" for c in M.PRICE_FIELDS)


@query("prices_upsert", f"""
WITH tgt AS (SELECT * FROM prices_t WHERE symbol_id % 2 = 0),
inc0 AS (SELECT id, symbol_id, price + 1.0 AS price, bid, ask, volume_24h, change_24h, change_percent_24h, market_cap,
                data_source, last_updated + INTERVAL 1 HOUR AS last_updated, created_at FROM prices_t
         UNION ALL SELECT {PRICE_COLS} FROM prices_t),
inc AS (SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol_id, data_source ORDER BY last_updated DESC, id DESC) AS rn
          FROM inc0 WHERE symbol_id % 5 <> 0) WHERE rn = 1)
SELECT coalesce(t.id, i.id) AS id, coalesce(t.symbol_id, i.symbol_id) AS symbol_id,
       coalesce(t.data_source, i.data_source) AS data_source, {_UPS_FIELDS},
       CASE WHEN i.id IS NOT NULL THEN i.last_updated ELSE t.last_updated END AS last_updated,
       coalesce(t.created_at, i.created_at) AS created_at,
       CASE WHEN t.id IS NULL THEN 'insert' WHEN i.id IS NOT NULL THEN 'update' ELSE 'keep' END AS action
FROM tgt t FULL OUTER JOIN inc i ON t.symbol_id = i.symbol_id AND t.data_source = i.data_source
""")
def prices_upsert(t: MarketTables) -> DataFrame:
    """Latest-price upsert on (symbol_id, data_source); newest incoming row wins."""
    target = t.prices.filter(F.pmod("symbol_id", F.lit(2)) == 0)
    newer = (t.prices.withColumn("price", F.col("price") + 1.0)
             .withColumn("last_updated", F.col("last_updated") + F.expr("INTERVAL 1 HOUR")))
    incoming = newer.unionByName(t.prices).filter(F.pmod("symbol_id", F.lit(5)) != 0)  # the others are kept
    return M.upsert_prices(target, incoming)


def _create_batch(t: MarketTables) -> DataFrame:
    online = t.pairs.filter(F.col("status") == "online")
    base = online.select(F.col("pair").alias("symbol"), FP.display_name().alias("name"))
    dup = online.filter(F.pmod(F.length("pair"), F.lit(2)) == 0).select(
        F.col("pair").alias("symbol"), F.concat(FP.display_name(), F.lit(" dup")).alias("name"))
    new = base.unionByName(dup).select("symbol", "name", F.lit(S.EXCHANGE_NAME).alias("exchange"),
                                       F.lit("crypto").alias("asset_type"), F.lit(None).cast("string").alias("currency"),
                                       F.lit(None).cast("boolean").alias("is_active"))
    again = t.symbols.filter(F.pmod("id", F.lit(5)) == 0).select("symbol", "name", "exchange", "asset_type",
                                                                 "currency", "is_active")
    same = new.filter(F.pmod(F.length("symbol"), F.lit(3)) == 0)                       # equal rows
    nameless = new.withColumn("symbol", F.concat(F.lit("N"), "symbol")).withColumn("name", F.lit(None).cast("string"))
    long = new.filter(F.pmod(F.length("symbol"), F.lit(4)) == 0).withColumn("exchange", F.repeat("symbol", 20))
    return new.unionByName(again).unionByName(same).unionByName(nameless).unionByName(long)


_DISPLAY = "coalesce(nullif(wsname, ''), nullif(altname, ''), pair)"
_LEN_CHECKS = " ".join(f"WHEN length({c}) > {S.SYMBOL_LENGTHS[c]} THEN '{c}_too_long'"
                       for c in ["symbol", "name", "exchange", "asset_type", "currency"])


@query("symbols_create", f"""
WITH inc AS (
  SELECT pair AS symbol, {_DISPLAY} AS name, 'Kraken' AS exchange, 'crypto' AS asset_type,
         CAST(NULL AS VARCHAR) AS currency, CAST(NULL AS BOOLEAN) AS is_active FROM pairs_t WHERE status = 'online'
  UNION ALL
  SELECT pair, {_DISPLAY} || ' dup', 'Kraken', 'crypto', NULL, NULL FROM pairs_t WHERE status = 'online' AND length(pair) % 2 = 0),
every AS (
  SELECT * FROM inc
  UNION ALL SELECT symbol, name, exchange, asset_type, currency, is_active FROM symbols_t WHERE id % 5 = 0
  UNION ALL SELECT * FROM inc WHERE length(symbol) % 3 = 0
  UNION ALL SELECT 'N' || symbol, NULL, exchange, asset_type, currency, is_active FROM inc
  UNION ALL SELECT symbol, name, repeat(symbol, 20), asset_type, currency, is_active FROM inc WHERE length(symbol) % 4 = 0),
d AS (SELECT symbol, name, exchange, asset_type, coalesce(currency, 'USD') AS currency, coalesce(is_active, true) AS is_active FROM every),
f AS (SELECT *, CASE WHEN name IS NULL THEN 'name_missing' {_LEN_CHECKS} END AS fault FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, fault IS NULL ORDER BY name, exchange, asset_type, currency, is_active) AS rn FROM f)
SELECT symbol, name, exchange, currency, is_active,
       CASE WHEN fault = 'name_missing' THEN fault
            WHEN symbol IN (SELECT symbol FROM symbols_t) THEN 'duplicate_symbol'
            WHEN fault IS NOT NULL THEN fault
            WHEN rn > 1 THEN 'duplicate_in_batch' ELSE 'created' END AS outcome
FROM n
""")
def symbols_create(t: MarketTables) -> DataFrame:
    """Create symbols with defaults; duplicates (existing or in-batch) are rejected."""
    created, rejected = M.create_symbols(t.symbols, _create_batch(t), _now())
    cols = ["symbol", "name", "exchange", "currency", "is_active"]
    return (created.select(*cols, F.lit("created").alias("outcome"))
            .unionByName(rejected.select(*cols, F.col("reason").alias("outcome"))))


def _changes(t: MarketTables) -> DataFrame:
    return t.symbols.filter(F.pmod("id", F.lit(3)) == 0).select(
        "symbol", F.concat("name", F.lit(" (updated)")).alias("name"),
        F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("industry"),
        (F.col("market_cap") * 2).alias("market_cap"))


def _update_sql(replace: bool) -> str:
    keep = lambda c: f"c.{c}" if replace else f"coalesce(c.{c}, s.{c})"
    return f"""
WITH c AS (SELECT symbol, name || ' (updated)' AS name, CAST(NULL AS VARCHAR) AS sector, CAST(NULL AS VARCHAR) AS industry,
                  market_cap * 2 AS market_cap, true AS hit FROM symbols_t WHERE id % 3 = 0)
SELECT s.id, s.symbol,
       CASE WHEN c.hit THEN {keep('name')} ELSE s.name END AS name, s.exchange, s.asset_type, s.currency,
       CASE WHEN c.hit THEN {keep('sector')} ELSE s.sector END AS sector,
       CASE WHEN c.hit THEN {keep('industry')} ELSE s.industry END AS industry,
       CASE WHEN c.hit THEN {keep('market_cap')} ELSE s.market_cap END AS market_cap,
       s.is_active, s.created_at,
       CASE WHEN c.hit THEN TIMESTAMP '{NOW}' ELSE s.updated_at END AS updated_at
FROM symbols_t s LEFT JOIN c ON c.symbol = s.symbol"""


@query("symbols_update", _update_sql(False))
def symbols_update(t: MarketTables) -> DataFrame:
    """U4: batch update by symbol, patch semantics (NULL keeps the old value)."""
    return M.update_symbols(t.symbols, _changes(t), _now())


@query("symbols_update_replace", _update_sql(True))
def symbols_update_replace(t: MarketTables) -> DataFrame:
    """U4 in the reference's form: all four fields written, missing ones become NULL."""
    return M.update_symbols(t.symbols, _changes(t), _now(), replace=True)


_MAP_SQL = "coalesce(CASE pair " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PAIR_SYMBOL_MAP.items()) + " END, pair)"


@query("symbols_sync", f"""
WITH syms AS (SELECT symbol, is_active FROM symbols_t UNION ALL SELECT pair, true FROM pairs_t WHERE length(pair) % 2 = 0),
m AS (SELECT pair, {_MAP_SQL} AS db_symbol FROM (SELECT pair FROM pairs_t UNION ALL SELECT 'OLD' || pair FROM pairs_t WHERE length(pair) > 8))
SELECT m.pair, m.db_symbol, coalesce(p.altname, m.db_symbol) AS name, coalesce(p.status = 'online', false) AS is_active,
       CASE WHEN s.symbol IS NULL THEN 'create'
            WHEN s.is_active IS NOT DISTINCT FROM coalesce(p.status = 'online', false) THEN 'none'
            ELSE 'update' END AS action
FROM m JOIN pairs_t p ON p.pair = m.pair LEFT JOIN syms s ON s.symbol = m.db_symbol
""")
def symbols_sync(t: MarketTables) -> DataFrame:
    """Diff of mapped exchange pairs against symbols -> create / update / none."""
    synced = t.pairs.filter(F.pmod(F.length("pair"), F.lit(2)) == 0).select(
        F.col("pair").alias("symbol"), F.lit(True).alias("is_active"))
    syms = t.symbols.select("symbol", "is_active").unionByName(synced)
    return M.sync_plan(_sync_mapping(t), t.pairs, syms)


def _sync_mapping(t: MarketTables) -> DataFrame:
    """The pair map: every pair of the metadata, and as many withdrawn ones that it no longer offers."""
    gone = t.pairs.filter(F.length("pair") > 8).select(F.concat(F.lit("OLD"), "pair").alias("pair"))
    return t.pairs.select("pair").unionByName(gone).select("pair", FP.pair_to_symbol(F.col("pair")).alias("db_symbol"))


@query("pairs_add", f"""
WITH r AS (SELECT requested, {_NORM_SQL} AS normalized FROM requests_t),
r2 AS (SELECT *, {_infer_sql('normalized')} AS db_symbol FROM r),
syms AS (SELECT symbol FROM symbols_t UNION ALL SELECT {_MAP_SQL} FROM pairs_t WHERE pair IN ('XBTUSDT', 'ADAUSDT')),
j AS (SELECT r2.*, p.altname, p.status, p.pair IS NOT NULL AS offered, s.symbol IS NOT NULL AS known,
             row_number() OVER (PARTITION BY r2.db_symbol, p.pair IS NOT NULL AND s.symbol IS NULL ORDER BY r2.requested, r2.normalized) AS rn
      FROM r2 LEFT JOIN pairs_t p ON p.pair = r2.normalized LEFT JOIN syms s ON s.symbol = r2.db_symbol)
SELECT requested, normalized, db_symbol,
       CASE WHEN NOT offered THEN 'not_found' WHEN known THEN 'exists' WHEN rn = 1 THEN 'create'
            ELSE 'duplicate_in_batch' END AS action,
       coalesce(altname, db_symbol) AS name,
       CASE WHEN contains(db_symbol, 'USD') THEN 'USD' ELSE 'EUR' END AS currency,
       coalesce(status = 'online', false) AS is_active
FROM j
""")
def pairs_add(t: MarketTables) -> DataFrame:
    """Add-pair requests -> not_found / exists / create plan."""
    known = t.pairs.filter(F.col("pair").isin("XBTUSDT", "ADAUSDT")).select(FP.pair_to_symbol(F.col("pair")).alias("symbol"))
    path = M.publish(t.pair_requests, fresh_path(t.spark, "pair-requests"))  # a batch arrives as a file
    requests = t.spark.read.schema("requested string").parquet(path)
    return M.add_pairs_plan(requests, t.pairs, t.symbols.select("symbol").unionByName(known))


INGEST_CUT = "2000-01-01 00:00:00"
# Bars of every eleventh symbol arrive with a negative open: they must end in quarantine.
_INGEST_BARS = "SELECT * REPLACE (CASE WHEN symbol_id % 11 = 0 THEN -open ELSE open END AS open) FROM candles_t"


def _ingest(t: MarketTables) -> tuple[str, DataFrame, list[DataFrame]]:
    """Two fetch batches of OHLC documents (the second re-sends the first) into a new stored table:
    its path, the symbols afterwards and the counts of each batch."""
    bars = t.candles.withColumn("open", F.when(F.pmod("symbol_id", F.lit(11)) == 0, -F.col("open")).otherwise(F.col("open")))
    path = fresh_path(t.spark, "market_data")
    with scratch(t.spark):
        landed = staging_path(t.spark, "ohlc-landed")
        SP.ohlc_payloads(bars, _ohlc_pair()).select("value").write.options(**PARQUET).parquet(landed)
        docs = PL.landed_documents(SP.read_arrivals(t.spark, landed), keep_text=False)  # both fetch batches read it
        discard(t.spark, landed)
        decoded = PL.decode_ohlc(PL.ohlc_records(PL.split_errors(docs)[0]), "1d").drop("last")
        batch1 = decoded.filter(F.col("t_stamp") < F.lit(INGEST_CUT).cast("timestamp"))
        syms, _, counts1 = M.ingest_ohlc(batch1, t.stored_symbols, path, _now())
        syms, _, counts2 = M.ingest_ohlc(decoded, syms, path, _now())
    return path, syms, [counts1, counts2]


@query("ohlc_ingest", f"""
SELECT {_MAP_SQL.replace('pair', 'p')} AS db_symbol, t_stamp, CAST(open AS DECIMAL(20, 8)) AS open, CAST(high AS DECIMAL(20, 8)) AS high,
       CAST(low AS DECIMAL(20, 8)) AS low, CAST(close AS DECIMAL(20, 8)) AS close, volume, time_frame, data_source,
       TIMESTAMP '{NOW}' AS created_at, 1 AS rows_of_id
FROM (SELECT {_OHLC_PAIR_SQL} AS p, t_stamp, open, high, low, close,
             CAST(round_even(CAST(volume AS DOUBLE), 0) AS BIGINT) AS volume, '1d' AS time_frame, 'kraken' AS data_source
      FROM ({_INGEST_BARS}) WHERE open > 0)
""")
def ohlc_ingest(t: MarketTables) -> DataFrame:
    """The stored candle table after two overlapping fetch batches: decoded, validated, symbols
    got or created, inserted with ids where new."""
    path, syms, _ = _ingest(t)
    stored = M.read_candles(t.spark, path)
    ids = stored.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("rows_of_id"))
    names = syms.select(F.col("id").alias("symbol_id"), F.col("symbol").alias("db_symbol"))
    return stored.join(names, "symbol_id").join(ids, "id").select(
        "db_symbol", "t_stamp", "open", "high", "low", "close", "volume", "time_frame", "data_source", "created_at", "rows_of_id")


@query("ohlc_ingest_metrics", f"""
WITH b AS ({_INGEST_BARS}), f AS (SELECT *, t_stamp < TIMESTAMP '{INGEST_CUT}' AS early FROM b)
SELECT 1 AS batch, 'fetched' AS metric, CAST(count_if(early) AS BIGINT) AS value FROM f
UNION ALL SELECT 1, 'inserted', CAST(count_if(early AND open > 0) AS BIGINT) FROM f
UNION ALL SELECT 1, 'quarantined', CAST(count_if(early AND open <= 0) AS BIGINT) FROM f
UNION ALL SELECT 2, 'fetched', count(*) FROM f
UNION ALL SELECT 2, 'inserted', CAST(count_if(NOT early AND open > 0) AS BIGINT) FROM f
UNION ALL SELECT 2, 'quarantined', CAST(count_if(open <= 0) AS BIGINT) FROM f
""")
def ohlc_ingest_metrics(t: MarketTables) -> DataFrame:
    """Fetched, inserted and quarantined rows of each fetch batch."""
    _, _, counts = _ingest(t)
    first, second = (c.select(F.lit(i + 1).alias("batch"), "metric", "value") for i, c in enumerate(counts))
    return first.unionByName(second)


@query("ohlc_first_arrival", f"""
SELECT {_MAP_SQL.replace('pair', 'p')} AS db_symbol, t_stamp, CAST(close AS DECIMAL(20, 8)) AS close, data_source
FROM (SELECT {_OHLC_PAIR_SQL} AS p, t_stamp, CASE WHEN symbol_id % 2 = 0 THEN close ELSE close + 1 END AS close, 'kraken' AS data_source
      FROM candles_t)
""")
def ohlc_first_arrival(t: MarketTables) -> DataFrame:
    """Two deliveries of every bar in one batch, for odd symbols the corrected one first: the first
    to arrive is stored, whatever its values."""
    path = fresh_path(t.spark, "market_data")
    odd = F.pmod("symbol_id", F.lit(2)) == 1
    with scratch(t.spark):
        landed = staging_path(t.spark, "ohlc-conflicts")
        with scratch(t.spark):
            bars = M.staged(t.candles, "bars")
            for corrected in (odd, ~odd):
                part = bars.withColumn("close", F.when(corrected, F.col("close") + 1).otherwise(F.col("close")))
                SP.ohlc_payloads(part, _ohlc_pair()).select("value").write.options(**PARQUET).mode("append").parquet(landed)
        docs = PL.landed_documents(SP.read_arrivals(t.spark, landed), keep_text=False)
        discard(t.spark, landed)
        decoded = PL.decode_ohlc(PL.ohlc_records(PL.split_errors(docs)[0]), "1d").drop("last")
        syms, _, _ = M.ingest_ohlc(decoded, t.stored_symbols, path, _now())
    names = syms.select(F.col("id").alias("symbol_id"), F.col("symbol").alias("db_symbol"))
    return M.read_candles(t.spark, path).join(names, "symbol_id").select("db_symbol", "t_stamp", "close", "data_source")


LATER = "2024-02-01 01:00:00"
_TICKER_SQL = """symbol_id, data_source, price, bid, ask, CASE WHEN volume_24h <> 0 THEN volume_24h END AS volume_24h,
       price - (price - change_24h) AS change_24h,
       CASE WHEN price - change_24h > 0 THEN (price - (price - change_24h)) / (price - change_24h) * 100 END AS change_percent_24h"""


@query("ticker_ingest", f"""
WITH a AS (SELECT {_TICKER_SQL} FROM prices_t WHERE symbol_id % 2 = 0),
b AS (SELECT {_TICKER_SQL} FROM (SELECT * REPLACE (price + 1 AS price) FROM prices_t) WHERE symbol_id % 3 <> 0 AND symbol_id % 5 <> 0),
j AS (SELECT coalesce(a.symbol_id, b.symbol_id) AS s, coalesce(a.data_source, b.data_source) AS d, a.symbol_id IS NOT NULL AS old,
             b.symbol_id IS NOT NULL AS hit, {", ".join(f"CASE WHEN b.symbol_id IS NOT NULL THEN b.{c} ELSE a.{c} END AS {c}" for c in M.PRICE_FIELDS[:-1])}
      FROM a FULL JOIN b ON a.symbol_id = b.symbol_id AND a.data_source = b.data_source)
SELECT {_OHLC_PAIR_SQL.replace("symbol_id", "s").replace("data_source", "d")} AS db_symbol, price, bid, ask, volume_24h, change_24h, change_percent_24h,
       'kraken' AS data_source, CASE WHEN hit THEN TIMESTAMP '{LATER}' ELSE TIMESTAMP '{NOW}' END AS last_updated,
       CASE WHEN old THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{LATER}' END AS created_at,
       CASE WHEN NOT old THEN 'insert' WHEN hit THEN 'update' ELSE 'keep' END AS action, 1 AS rows_of_id
FROM j
""")
def ticker_ingest(t: MarketTables) -> DataFrame:
    """The stored price table after two batches of ticker documents: decoded, validated
    (the second holds negative prices), symbols got or created, upserted with ids."""
    docs = lambda p: PL.decode_ticker(PL.landed_documents(SP.ticker_payloads(p, _ohlc_pair()).select("value"))).drop("value")
    later = t.prices.filter(F.pmod("symbol_id", F.lit(3)) != 0)
    later = later.withColumn("price", F.when(F.pmod("symbol_id", F.lit(5)) == 0, -F.col("price")).otherwise(F.col("price") + 1.0))
    empty = t.spark.createDataFrame([], S.REAL_TIME_PRICES)
    syms, _, prices = M.ingest_tickers(docs(t.prices.filter(F.pmod("symbol_id", F.lit(2)) == 0)), t.symbols, empty, _now())
    path = M.publish(prices.drop("action"), fresh_path(t.spark, "real_time_prices"))
    stored = t.spark.read.schema(S.REAL_TIME_PRICES).parquet(path)
    syms, _, prices = M.ingest_tickers(docs(later), syms, stored, F.lit(LATER).cast("timestamp"))
    path = M.publish(prices, fresh_path(t.spark, "real_time_prices"))
    prices = t.spark.read.parquet(path)
    ids = prices.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("rows_of_id"))
    names = syms.select(F.col("id").alias("symbol_id"), F.col("symbol").alias("db_symbol"))
    return prices.join(names, "symbol_id").join(ids, "id").select(
        "db_symbol", *M.PRICE_FIELDS[:-1], "data_source", "last_updated", "created_at", "action", "rows_of_id")


@query("payload_quarantine", """
WITH k AS (SELECT DISTINCT symbol_id, data_source, strftime(t_stamp, '%Y-%m') AS ym FROM candles_t),
d AS (SELECT (symbol_id + CAST(substr(ym, 6, 2) AS INTEGER)) % 7 AS k FROM k),
t AS (SELECT symbol_id % 8 AS k FROM prices_t),
p AS (SELECT length(pair) % 2 = 0 AS spoilt, CAST(coalesce(TRY_CAST(regexp_extract(pair, '(\\d+)$', 1) AS BIGINT), 0) // 100 AS BIGINT) AS doc FROM pairs_t)
SELECT 'ohlc' AS kind, CASE WHEN k < 3 THEN 'document' ELSE 'record' END AS level,
       CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'error' WHEN 2 THEN 'no_result' WHEN 3 THEN 'short_record'
              WHEN 4 THEN 'bad_volume' ELSE 'bad_time' END AS reason, count(*) AS rejected
FROM d WHERE k < 6 GROUP BY ALL
UNION ALL
SELECT 'ticker', CASE WHEN k < 3 THEN 'document' ELSE 'record' END,
       CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'error' WHEN 2 THEN 'no_pair' WHEN 3 THEN 'bad_ticker' WHEN 4 THEN 'bad_price'
              WHEN 5 THEN 'bad_quote' ELSE 'bad_volume' END, count(*)
FROM t WHERE k < 7 GROUP BY ALL
UNION ALL SELECT 'pairs', 'document', 'error', count(DISTINCT doc) FROM p WHERE doc % 3 = 1 HAVING count(*) > 0
UNION ALL SELECT 'pairs', 'record', 'bad_info', count(*) FROM p WHERE doc % 3 <> 1 AND spoilt HAVING count(*) > 0
""")
def payload_quarantine(t: MarketTables) -> DataFrame:
    """What the decoders set aside, by reason. Six of seven OHLC and seven of eight ticker
    documents are spoilt, each in one way; every third metadata document is an error, and in the
    others the entries of pairs of even length are no objects."""
    docs = SP.ohlc_payloads(t.candles, _ohlc_pair())
    k = F.pmod(F.regexp_extract("pair", r"^S(\d+)-", 1).cast("int") + F.substring("ym", 6, 2).cast("int"), F.lit(7))
    more = lambda rec: F.replace("value", F.lit(']],"last"'), F.lit(f'],{rec}],"last"'))
    value = (F.when(k == 0, F.substring(F.col("value"), F.lit(1), F.length("value") - 3))
             .when(k == 1, '{"error":["EService:Busy"],"result":{}}').when(k == 2, '{"error":[]}')
             .when(k == 3, more('[1,"2","3"]')).when(k == 4, more('[1,"1","1","1","1","1","1e30",1]'))
             .when(k == 5, more('["x","1","1","1","1","1","1",1]')).otherwise(F.col("value")))
    prices = SP.ticker_payloads(t.prices, _ohlc_pair())
    n = F.pmod("symbol_id", F.lit(8))
    one = lambda ticker: F.lit('{"error":[],"result":{"P":' + ticker + '}}')
    spoilt = (F.when(n == 0, F.substring(F.col("value"), F.lit(1), F.length("value") - 2)).when(n == 1, '{"error":["EQuery:Unknown"],"result":{}}')
              .when(n == 2, '{"error":[],"result":{}}').when(n == 3, one('"closed"')).when(n == 4, one('{"c":["n/a","1"]}'))
              .when(n == 5, one('{"c":["1","1"],"a":["?"]}')).when(n == 6, one('{"c":["1","1"],"v":["1","x"]}')).otherwise(F.col("value")))
    doc = F.floor(F.coalesce(F.regexp_extract("pair", r"(\d+)$", 1).try_cast("bigint"), F.lit(0)) / SP.PAIRS_PER_DOC)
    even = F.pmod(F.length("pair"), F.lit(2)) == 0
    infos = SP.pair_payloads(t.pairs.filter(~even), doc).select("doc", "value")
    names = t.pairs.filter(even).groupBy(doc.alias("doc")).agg(F.array_join(F.transform(F.collect_list("pair"), lambda x: F.concat(F.lit('"'), x, F.lit('":7'))), ",").alias("bad"))
    infos = infos.join(names, "doc", "full_outer").select(
        F.when(F.pmod("doc", F.lit(3)) == 1, '{"error":["EGeneral:Down"]}').when(F.col("value").isNull(), F.concat(F.lit('{"error":[],"result":{'), "bad", F.lit("}}")))
        .when(F.col("bad").isNull(), F.col("value")).otherwise(F.concat(F.expr("substring(value, 1, length(value) - 2)"), F.lit(","), "bad", F.lit("}}"))).alias("value"))
    out = [(kind, reject(PL.landed_documents(raw))) for kind, raw, reject in (
        ("ohlc", docs.select(value.alias("value")), PL.ohlc_rejects), ("ticker", prices.select(spoilt.alias("value")), PL.ticker_rejects),
        ("pairs", infos, PL.pair_rejects))]
    parts = [df.groupBy("level", "reason").agg(F.count(F.lit(1)).alias("rejected")).select(F.lit(kind).alias("kind"), "level", "reason", "rejected") for kind, df in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SEED_VALUES = ", ".join(
    "('{}', '{}', '{}', '{}', '{}', '{}', '{}', {})".format(*(x.replace("'", "''") for x in r[:7]),
                                                         "NULL" if r[7] is None else r[7])
    for r in S.SEED_SYMBOLS)


@query("seed_load", f"""
WITH seed AS (SELECT * FROM (VALUES {_SEED_VALUES})
              AS v(symbol, name, exchange, asset_type, currency, sector, industry, market_cap))
SELECT symbol, name, exchange, asset_type, currency, sector, industry, market_cap, is_active FROM symbols_t
UNION ALL
SELECT symbol, name, exchange, asset_type, currency, sector, industry, CAST(market_cap AS BIGINT), true
FROM seed WHERE symbol NOT IN (SELECT symbol FROM symbols_t)
""")
def seed_load(t: MarketTables) -> DataFrame:
    """Load the reference seed symbols into the symbols table, ON CONFLICT DO NOTHING."""
    from ..sources.tables import seed_symbols

    cols = ["symbol", "name", "exchange", "asset_type", "currency", "sector", "industry", "market_cap", "is_active"]
    seeds = seed_symbols(t.spark)
    created, _ = M.create_symbols(t.symbols, M.insert_ignore(t.symbols, seeds, ["symbol"], ["name"]), _now())
    return t.symbols.select(*cols).unionByName(created.select(*cols))


@query("snapshot_freshness", f"""
WITH s AS (SELECT data_source, max(ts) AS fetched_at FROM ticks_t GROUP BY data_source)
SELECT data_source, fetched_at, max(fetched_at) OVER () AS as_of,
       (epoch_us(max(fetched_at) OVER ()) - epoch_us(fetched_at)) // 1000000 AS age_seconds,
       fetched_at < max(fetched_at) OVER () - INTERVAL {S.PAIR_CACHE_SECONDS} SECOND AS is_stale
FROM s
""")
def snapshot_freshness(t: MarketTables) -> DataFrame:
    """Newest snapshot per source and whether it is older than the 1 h cache lifetime."""
    from ..operators.snapshots import freshness

    return freshness(t.ticks, "data_source", "ts", S.PAIR_CACHE_SECONDS)


CHECKS = ["2024-02-01 00:40:00", "2024-02-01 01:20:00", "2024-02-01 03:30:00"]  # before, within and past a snapshot's hour


@query("pairs_cached", f"""
WITH snap AS (SELECT pair, status, TIMESTAMP '2024-02-01 00:00:00' AS fetched_at FROM pairs_t WHERE length(pair) % 2 = 0
              UNION ALL SELECT pair, status, TIMESTAMP '2024-02-01 01:00:00' FROM pairs_t),
c AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in CHECKS)}]) AS checked_at),
n AS (SELECT checked_at, max(fetched_at) AS fetched_at FROM c JOIN (SELECT DISTINCT fetched_at FROM snap) s ON s.fetched_at <= c.checked_at GROUP BY checked_at)
SELECT n.checked_at, s.pair, s.status, s.fetched_at, epoch(n.checked_at) - epoch(s.fetched_at) < {S.PAIR_CACHE_SECONDS} AS from_cache
FROM n JOIN snap s ON s.fetched_at = n.fetched_at
""")
def pairs_cached(t: MarketTables) -> DataFrame:
    """The pair snapshot that would be served at three instants, and whether from cache."""
    from ..operators.snapshots import newest_snapshot

    at = lambda x: F.lit(x).cast("timestamp")
    pairs = t.pairs.select("pair", "status")
    snaps = (pairs.filter(F.pmod(F.length("pair"), F.lit(2)) == 0).withColumn("fetched_at", at(CHECKS[0][:11] + "00:00:00"))
             .unionByName(pairs.withColumn("fetched_at", at(CHECKS[0][:11] + "01:00:00"))))
    parts = [newest_snapshot(snaps, at(x), S.PAIR_CACHE_SECONDS).select(at(x).alias("checked_at"), "pair", "status", "fetched_at", "from_cache")
             for x in CHECKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("symbols_synced", f"""
WITH base AS (SELECT symbol, name, exchange, is_active FROM symbols_t UNION ALL SELECT pair, pair, 'Kraken', true FROM pairs_t WHERE length(pair) % 2 = 0),
m AS (SELECT pair, {_MAP_SQL} AS db_symbol, coalesce(altname, {_MAP_SQL}) AS name, coalesce(status = 'online', false) AS online FROM pairs_t)
SELECT b.symbol, b.name, b.exchange, coalesce(m.online, b.is_active) AS is_active FROM base b LEFT JOIN m ON m.db_symbol = b.symbol
UNION ALL SELECT db_symbol, name, 'Kraken', online FROM m WHERE db_symbol NOT IN (SELECT symbol FROM base)
""")
def symbols_synced(t: MarketTables) -> DataFrame:
    """The symbols table after a sync over the pair map is applied (created, switched, unchanged)."""
    known = t.pairs.filter(F.pmod(F.length("pair"), F.lit(2)) == 0).select(
        F.col("pair").alias("symbol"), F.col("pair").alias("name"), F.lit(S.EXCHANGE_NAME).alias("exchange"),
        F.lit("crypto").alias("asset_type"), F.lit("USD").alias("currency"), F.lit(True).alias("is_active"))
    created, _ = M.create_symbols(t.symbols, known, _now())
    path = M.publish(t.symbols.unionByName(created), fresh_path(t.spark, "symbols"))
    symbols = t.spark.read.schema(S.SYMBOLS).parquet(path)
    return M.apply_sync(M.sync_plan(_sync_mapping(t), t.pairs, symbols), symbols, _now()).select("symbol", "name", "exchange", "is_active")


@query("related_write", """
WITH s AS (SELECT id, symbol FROM symbols_t WHERE id % 3 = 0)
SELECT 'N' || s.symbol AS symbol, (SELECT count(*) FROM candles_t c WHERE c.symbol_id = s.id) AS bars,
       (SELECT count(*) FROM prices_t p WHERE p.symbol_id = s.id) AS prices, false AS after_clean_up
FROM s
UNION ALL SELECT s.symbol, (SELECT count(*) FROM candles_t c WHERE c.symbol_id = s.id), (SELECT count(*) FROM prices_t p WHERE p.symbol_id = s.id), true
FROM symbols_t s
""")
def related_write(t: MarketTables) -> DataFrame:
    """New symbols with their candles and prices are written, read back by their join, and cleaned up:
    deleting the symbols takes the related rows with them and leaves the others."""
    third = t.symbols.filter(F.pmod("id", F.lit(3)) == 0)
    incoming = third.select(F.concat(F.lit("N"), "symbol").alias("symbol"), "name", "exchange", "asset_type", "currency", "is_active")
    created = M.staged(M.create_symbols(t.symbols, incoming, _now())[0], "related-symbols")
    ids = created.join(third.select(F.col("id").alias("old"), F.concat(F.lit("N"), "symbol").alias("symbol")), "symbol").select("id", "old")
    copies = lambda df: df.join(ids.select(F.col("old").alias("symbol_id"), F.col("id").alias("_new")), "symbol_id").withColumn(
        "symbol_id", F.col("_new").cast("int")).select(*df.columns)
    candles = M.write_candles(t.candles.unionByName(copies(t.candles)), fresh_path(t.spark, "related-candles"))
    prices = M.publish(t.prices.unionByName(copies(t.prices)), fresh_path(t.spark, "related-prices"))
    tables = {"symbols": t.symbols.unionByName(created), "candles": M.read_candles(t.spark, candles),
              "prices": t.spark.read.schema(S.REAL_TIME_PRICES).parquet(prices)}

    def related(x: dict[str, DataFrame], which: DataFrame, cleaned: bool) -> DataFrame:
        n = {name: x[name].groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias(out)) for name, out in (("candles", "bars"), ("prices", "prices"))}
        return which.join(n["candles"], "id", "left").join(n["prices"], "id", "left").select(
            "symbol", F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("prices", F.lit(0)).alias("prices"), F.lit(cleaned).alias("after_clean_up"))

    gone = M.delete_symbols(tables["symbols"], F.col("symbol").startswith("N") & (F.col("created_at") == _now()), candles=tables["candles"], prices=tables["prices"])
    return related(tables, tables["symbols"].join(created.select("id"), "id", "left_semi"), False).unionByName(related(gone, gone["symbols"], True))


_ADDED = f"""
WITH r AS (SELECT requested, {_NORM_SQL} AS normalized FROM requests_t),
r2 AS (SELECT *, {_infer_sql('normalized')} AS db_symbol FROM r),
offered AS (SELECT r2.*, p.altname, p.status FROM r2 JOIN pairs_t p ON p.pair = r2.normalized
            WHERE r2.db_symbol NOT IN (SELECT symbol FROM symbols_t)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_symbol ORDER BY requested, normalized) AS rn FROM offered) WHERE rn = 1)
SELECT db_symbol AS symbol, coalesce(altname, db_symbol) AS name, CASE WHEN contains(db_symbol, 'USD') THEN 'USD' ELSE 'EUR' END AS currency,
       coalesce(status = 'online', false) AS is_active, CAST(CASE WHEN length(normalized) % 5 <> 0 THEN length(normalized) * 1.5 END AS DOUBLE) AS price, 1 AS rows_of_symbol
FROM one WHERE length(db_symbol) <= {S.SYMBOL_LENGTHS['symbol']}
UNION ALL SELECT symbol, name, currency, is_active, NULL, 1 FROM symbols_t"""


@query("pairs_added", _ADDED)
def pairs_added(t: MarketTables) -> DataFrame:
    """A batch of add-pair requests carried out: the stored symbols afterwards with the prices
    seeded from tickers (pairs of some lengths have none). The batch is run twice; the rerun changes nothing."""
    path = M.publish(t.pair_requests, fresh_path(t.spark, "pair-requests"))
    requests = t.spark.read.schema("requested string").parquet(path)
    n = F.length("pair") * F.lit(1.5)
    quoted = t.pairs.filter(F.pmod(F.length("pair"), F.lit(5)) != 0).select(
        "pair", F.lit(0).alias("symbol_id"), F.lit("kraken").alias("data_source"), n.alias("price"), n.alias("ask"), n.alias("bid"),
        F.lit(7).alias("volume_24h"), F.lit(0.0).alias("change_24h"))
    # a ticker a pair: the few files of the metadata are dealt to all tasks, and a document is decoded once for both runs
    docs = PL.landed_documents(SP.ticker_payloads(quoted.repartition("pair"), F.col("pair")).select("value"))
    tickers = M.staged(PL.decode_ticker(docs), "tickers")
    symbols, prices = t.symbols, t.spark.createDataFrame([], S.REAL_TIME_PRICES)
    for _ in range(2):
        _, symbols, priced = M.add_pairs(requests, t.pairs, symbols, tickers, prices, _now())
        prices = t.spark.read.schema(S.REAL_TIME_PRICES).parquet(M.publish(priced.drop("action"), fresh_path(t.spark, "pair-prices")))
    counts = symbols.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("rows_of_symbol"))
    return (symbols.join(prices.select(F.col("symbol_id").alias("id"), "price"), "id", "left").join(counts, "symbol")
            .select("symbol", "name", "currency", "is_active", "price", "rows_of_symbol"))


_SOURCES_SQL = ", ".join("('{}', '{}')".format(*r[:2]) for r in S.SEED_DATA_SOURCES)
_SESSIONS_SQL = ", ".join("('{}', '{}', '{}')".format(*r[:3]) for r in S.SEED_SESSIONS)


@query("seed_small_tables", f"""
WITH src AS (SELECT DISTINCT data_source AS k FROM candles_t UNION SELECT 'binance'),
ses AS (SELECT DISTINCT exchange, 'Regular Trading' AS session_name FROM symbols_t WHERE id % 4 = 0)
SELECT 'data_sources' AS table_name, k AS key, 'https://stored' AS value FROM src
UNION ALL SELECT 'data_sources', v.n, v.u FROM (VALUES {_SOURCES_SQL}) AS v(n, u) WHERE v.n NOT IN (SELECT k FROM src)
UNION ALL SELECT 'market_sessions', exchange || '/' || session_name, 'stored' FROM ses
UNION ALL SELECT 'market_sessions', v.e || '/' || v.s, v.z FROM (VALUES {_SESSIONS_SQL}) AS v(e, s, z)
          WHERE (v.e, v.s) NOT IN (SELECT (exchange, session_name) FROM ses)
""")
def seed_small_tables(t: MarketTables) -> DataFrame:
    """The seed data sources and sessions loaded twice by insert-ignore into tables that hold some of them."""
    from ..sources.tables import data_sources, market_sessions

    names = t.candles.select(F.col("data_source").alias("name")).distinct().unionByName(t.spark.range(1).select(F.lit("binance").alias("name")))
    sources = names.select("name", F.lit("https://stored").alias("base_url"))
    sessions = t.symbols.filter(F.pmod("id", F.lit(4)) == 0).select("exchange").distinct().select(
        "exchange", F.lit("Regular Trading").alias("session_name"), F.lit("stored").alias("timezone"))
    for _ in range(2):
        for key, seeds in (("name", data_sources(t.spark)), ("exchange", market_sessions(t.spark))):
            table = sources if key == "name" else sessions
            keys = ["name"] if key == "name" else ["exchange", "session_name"]
            new = M.staged(M.insert_ignore_table(table, seeds.select(*table.columns), keys, table.columns), f"seeded-{key}")
            sources, sessions = (new, sessions) if key == "name" else (sources, new)
    return (sources.select(F.lit("data_sources").alias("table_name"), F.col("name").alias("key"), F.col("base_url").alias("value"))
            .unionByName(sessions.select(F.lit("market_sessions").alias("table_name"), F.concat_ws("/", "exchange", "session_name").alias("key"),
                                         F.col("timezone").alias("value"))))


@query("sync_metrics", f"""
WITH syms AS (SELECT symbol, is_active FROM symbols_t UNION ALL SELECT pair, true FROM pairs_t WHERE length(pair) % 2 = 0),
m AS (SELECT pair, {_MAP_SQL} AS db_symbol FROM (SELECT pair FROM pairs_t UNION ALL SELECT 'OLD' || pair FROM pairs_t WHERE length(pair) > 8)),
plan AS (
  SELECT CASE WHEN s.symbol IS NULL THEN 'create'
              WHEN s.is_active IS NOT DISTINCT FROM coalesce(p.status = 'online', false) THEN 'none'
              ELSE 'update' END AS action
  FROM m JOIN pairs_t p ON p.pair = m.pair LEFT JOIN syms s ON s.symbol = m.db_symbol)
SELECT CAST(count_if(action = 'create') AS BIGINT) AS created, CAST(count_if(action = 'update') AS BIGINT) AS updated,
       (SELECT count(*) FROM m) AS total_pairs
FROM plan
""")
def sync_metrics(t: MarketTables) -> DataFrame:
    """A5: created / updated counts of a symbol sync, and the pairs of the whole map (offered or not)."""
    done = symbols_sync(t).agg(F.count_if(F.col("action") == "create").alias("created"),
                               F.count_if(F.col("action") == "update").alias("updated"))
    whole = _sync_mapping(t).agg(F.count(F.lit(1)).alias("total_pairs"))
    return done.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").drop("_k")
