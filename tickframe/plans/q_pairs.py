"""Registered pair-metadata and payload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import pairs as FP
from ..functions import payload as PL
from ..functions import timeframes as FT
from ..operators import reads as R
from ..sources import payloads as SP
from ..sources.catalog import MarketTables
from .registry import query

SEARCH = "red"
COUNT_SEARCH = "eco"

_DISPLAY = "coalesce(nullif(wsname, ''), nullif(altname, ''), pair)"


def _search_sql(term: str) -> str:
    from ..functions.pairs import SEARCH_COLUMNS, search_terms

    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')"
                             for t in search_terms(term) for c in SEARCH_COLUMNS) + ")"


_DETAIL = (f"pair, {_DISPLAY} AS name, coalesce(altname, pair) AS altname, coalesce(base, '') AS base, "
           "coalesce(quote, '') AS quote, coalesce(status, 'unknown') AS status")


def _pair_detail(df: DataFrame) -> DataFrame:
    """A listed pair; what the metadata lacks gets the listing's defaults."""
    return df.select("pair", FP.display_name().alias("name"), F.coalesce("altname", "pair").alias("altname"),
                     F.coalesce("base", F.lit("")).alias("base"), F.coalesce("quote", F.lit("")).alias("quote"),
                     F.coalesce("status", F.lit("unknown")).alias("status"))


@query("pairs_search", f"""
SELECT {_DETAIL} FROM pairs_t
WHERE status = 'online' AND {_search_sql(SEARCH)}
""")
def pairs_search(t: MarketTables) -> DataFrame:
    """Online pairs matching a search term in any of five text columns."""
    return _pair_detail(t.pairs.filter(FP.status_filter("online") & FP.matches_search(SEARCH)))


@query("pairs_search_alias", f"""
SELECT {_DETAIL} FROM pairs_t WHERE {_search_sql('btc')}
""")
def pairs_search_alias(t: MarketTables) -> DataFrame:
    """A term with an exchange alias (btc also finds xbt), any status."""
    return _pair_detail(t.pairs.filter(FP.status_filter("all") & FP.matches_search("btc")))


@query("pairs_page", f"""
SELECT {_DETAIL} FROM pairs_t
ORDER BY pair LIMIT 50 OFFSET 20
""")
def pairs_page(t: MarketTables) -> DataFrame:
    """All statuses, sorted by pair key, third page of 50... offset 20."""
    return _pair_detail(R.page(t.pairs.filter(FP.status_filter("all")), [F.col("pair")], 50, 20))


@query("pairs_counts", f"""
SELECT count(*) AS total_pairs, CAST(count_if(status = 'online') AS BIGINT) AS active_pairs,
       CAST(count_if(status = 'online' AND {_search_sql(COUNT_SEARCH)}) AS BIGINT) AS filtered_pairs
FROM pairs_t
""")
def pairs_counts(t: MarketTables) -> DataFrame:
    """A4: total / active / filtered pair counts in one pass."""
    flt = FP.status_filter("online") & FP.matches_search(COUNT_SEARCH)
    return t.pairs.agg(F.count(F.lit(1)).alias("total_pairs"),
                       F.count_if(F.col("status") == "online").alias("active_pairs"),
                       F.count_if(flt).alias("filtered_pairs"))


_NORM_SQL = ("CASE upper(regexp_replace(requested, '[/-]', '', 'g')) "
             + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PAIR_NORMALIZE_MAP.items())
             + " ELSE upper(regexp_replace(requested, '[/-]', '', 'g')) END")


@query("pair_normalize", f"""
SELECT requested, {_NORM_SQL} AS normalized FROM requests_t
""")
def pair_normalize(t: MarketTables) -> DataFrame:
    """user-typed pair names -> exchange pair keys."""
    return t.pair_requests.select("requested", FP.normalize_pair(F.col("requested")).alias("normalized"))


def _infer_sql(c: str) -> str:
    s = f"(CASE WHEN starts_with({c}, 'XBT') THEN replace({c}, 'XBT', 'BTC') ELSE {c} END)"
    whens = " ".join(
        f"WHEN strpos({s}, '/') = 0 AND length({s}) > 6 AND ends_with({s}, '{q}') "
        f"THEN substr({s}, 1, length({s}) - {len(q)}) || '/{q}'"
        for q in ["USD", "USDT", "EUR", "GBP"])
    return f"(CASE {whens} ELSE {s} END)"


@query("symbol_infer", f"""
SELECT normalized, {_infer_sql('normalized')} AS db_symbol,
       CASE WHEN contains({_infer_sql('normalized')}, 'USD') THEN 'USD' ELSE 'EUR' END AS currency
FROM (SELECT {_NORM_SQL} AS normalized FROM requests_t)
""")
def symbol_infer(t: MarketTables) -> DataFrame:
    """database symbol and currency inferred from each normalised request."""
    n = t.pair_requests.select(FP.normalize_pair(F.col("requested")).alias("normalized"))
    sym = FP.infer_symbol(F.col("normalized"))
    return n.select("normalized", sym.alias("db_symbol"), FP.currency_of(sym).alias("currency"))


_MAP2 = S.PAIR_SYMBOL_MAP


@query("pair_to_symbol", f"""
SELECT pair, coalesce(CASE pair {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAP2.items())} END, pair) AS db_symbol,
       coalesce(status = 'online', false) AS is_active
FROM pairs_t
""")
def pair_to_symbol(t: MarketTables) -> DataFrame:
    """exchange pair -> database symbol (identity when unmapped), online -> active."""
    return t.pairs.select("pair", FP.pair_to_symbol(F.col("pair")).alias("db_symbol"),
                          FP.is_online(F.col("status")).alias("is_active"))


@query("pairs_mapped", f"""
WITH r AS (SELECT requested, {_NORM_SQL} AS normalized FROM requests_t),
alt AS (SELECT upper(altname) AS altname, min(pair) AS pair
        FROM pairs_t WHERE altname <> '' GROUP BY upper(altname))
SELECT r.requested, p.pair, p.status, 'pair' AS matched_by FROM r JOIN pairs_t p ON p.pair = r.normalized
UNION ALL
SELECT r.requested, p.pair, p.status, 'altname' FROM r JOIN alt a ON a.altname = r.normalized JOIN pairs_t p ON p.pair = a.pair
WHERE r.normalized NOT IN (SELECT pair FROM pairs_t)
""")
def pairs_mapped(t: MarketTables) -> DataFrame:
    """Requests that the exchange offers, by the pair key, else by the alternative name."""
    from ..operators.pairs import requests_offered

    return requests_offered(t.pair_requests, t.pairs)


@query("pairs_missing", f"""
SELECT r.requested, r.normalized FROM (SELECT requested, {_NORM_SQL} AS normalized FROM requests_t) r
WHERE NOT EXISTS (SELECT 1 FROM pairs_t p WHERE p.pair = r.normalized)
""")
def pairs_missing(t: MarketTables) -> DataFrame:
    """Requests for pairs the exchange does not offer (the reference answers 404)."""
    from ..operators.pairs import requests_not_offered

    return requests_not_offered(t.pair_requests, t.pairs)


# --------------------------------------------------------------------------- payload decoding
def _ohlc_pair():
    return F.concat(F.lit("S"), F.col("symbol_id").cast("string"), F.lit("-"), F.col("data_source"))


_OHLC_PAIR_SQL = "'S' || CAST(symbol_id AS VARCHAR) || '-' || data_source"


def _decoded_candles(t: MarketTables) -> DataFrame:
    docs = PL.landed_documents(SP.ohlc_payloads(t.candles, _ohlc_pair()).select("value"), keep_text=False)
    ok, _ = PL.split_errors(docs)
    return PL.decode_ohlc(PL.ohlc_records(ok), "1d").drop("slot")


@query("ohlc_decode", f"""
SELECT {_OHLC_PAIR_SQL} AS pair, t_stamp, open, high, low, close, CAST(round_even(CAST(volume AS DOUBLE), 0) AS BIGINT) AS volume,
       close AS adjusted_close, '1d' AS time_frame, 'kraken' AS data_source
FROM candles_t
""")
def ohlc_decode(t: MarketTables) -> DataFrame:
    """Render candles as exchange OHLC documents, decode them back."""
    return _decoded_candles(t).drop("last")


@query("ohlc_tail", f"""
SELECT pair, t_stamp, open, high, low, close, volume FROM (
  SELECT {_OHLC_PAIR_SQL} AS pair, t_stamp, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol_id, data_source ORDER BY t_stamp DESC) AS rn
  FROM candles_t) WHERE rn <= 30
""")
def ohlc_tail(t: MarketTables) -> DataFrame:
    """Keep only the last 30 decoded candles of each pair."""
    d = _decoded_candles(t)
    return R.latest_n_per_series(d, 30, ["pair"], [F.col("t_stamp").desc()]).select(
        "pair", "t_stamp", "open", "high", "low", "close", "volume")


INCREMENTAL_CUT = "2000-01-01 00:00:00"


@query("ohlc_incremental", f"""
WITH hwm AS (SELECT symbol_id, data_source, max(t_stamp) AS hwm FROM candles_t
             WHERE t_stamp < TIMESTAMP '{INCREMENTAL_CUT}' GROUP BY symbol_id, data_source)
SELECT {_OHLC_PAIR_SQL.replace('symbol_id', 'c.symbol_id').replace('data_source', 'c.data_source')} AS pair,
       c.t_stamp, c.open, c.high, c.low, c.close, c.volume
FROM candles_t c LEFT JOIN hwm h ON c.symbol_id = h.symbol_id AND c.data_source = h.data_source
WHERE h.hwm IS NULL OR c.t_stamp > h.hwm
""")
def ohlc_incremental(t: MarketTables) -> DataFrame:
    """High-water mark per series from the stored table; keep only newer fetched rows."""
    from ..operators.pairs import newer_than_stored

    stored = t.candles.filter(F.col("t_stamp") < F.lit(INCREMENTAL_CUT).cast("timestamp"))
    stored = stored.select(_ohlc_pair().alias("pair"), "t_stamp")
    return newer_than_stored(_decoded_candles(t), stored, ["pair"]).select(
        "pair", "t_stamp", "open", "high", "low", "close", "volume")


@query("ticker_decode", f"""
SELECT {_OHLC_PAIR_SQL} AS pair, price, bid, ask,
       CASE WHEN volume_24h <> 0 THEN volume_24h END AS volume_24h,
       price - (price - change_24h) AS change_24h,
       CASE WHEN price - change_24h > 0 THEN (price - (price - change_24h)) / (price - change_24h) * 100 END AS change_percent_24h,
       'kraken' AS data_source
FROM prices_t
""")
def ticker_decode(t: MarketTables) -> DataFrame:
    """Render prices as ticker documents, decode them back."""
    docs = PL.landed_documents(SP.ticker_payloads(t.prices, _ohlc_pair()).select("value"))
    return PL.decode_ticker(docs).select("pair", "price", "bid", "ask", "volume_24h", "change_24h",
                                        "change_percent_24h", "data_source")


@query("ticker_branches", f"""
WITH k AS (SELECT *, symbol_id % 8 AS k, {_OHLC_PAIR_SQL} AS pair FROM prices_t)
SELECT pair, CASE WHEN k = 0 THEN 0.0 ELSE price END AS price, CASE k WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE bid END AS bid,
       CASE k WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE ask END AS ask,
       CAST(CASE k WHEN 3 THEN NULL WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE 7 END AS BIGINT) AS volume_24h,
       CASE WHEN k IN (0, 5, 6) THEN NULL WHEN k = 7 THEN price - 0.0 ELSE price - 4.0 END AS change_24h,
       CASE WHEN k IN (0, 5, 6, 7) THEN NULL ELSE (price - 4.0) / 4.0 * 100 END AS change_percent_24h
FROM k
""")
def ticker_branches(t: MarketTables) -> DataFrame:
    """tickers by each branch: no last trade and no open, quotes absent or empty, volume zero, under
    one or missing, open empty text with a missing volume, numeric zero or zero as text."""
    q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    last, volume, open_ = F.concat(F.lit('"c":['), q("price"), F.lit(',"1"],')), F.lit('"v":["1","7.5"],'), F.lit('"o":"4"')
    quotes = F.concat(F.lit('"a":['), q("ask"), F.lit(',"1","1"],"b":['), q("bid"), F.lit(',"1","1"],'))
    k = F.pmod("symbol_id", F.lit(8))
    body = (F.when(k == 0, F.concat(quotes, F.lit('"v":["1","7.5"]')))
            .when(k == 1, F.concat(last, volume, open_)).when(k == 2, F.concat(last, F.lit('"a":[],"b":[],'), volume, open_))
            .when(k == 3, F.concat(last, quotes, F.lit('"v":["1","0"],'), open_)).when(k == 4, F.concat(last, quotes, F.lit('"v":["1","0.9"],'), open_))
            .when(k == 5, F.concat(last, quotes, F.lit('"v":["1"],"o":""'))).when(k == 6, F.concat(last, quotes, volume, F.lit('"o":0')))
            .otherwise(F.concat(last, quotes, volume, F.lit('"o":"0"'))))
    raw = t.prices.select(F.concat(F.lit('{"error":[],"result":{"'), _ohlc_pair(), F.lit('":{'), body, F.lit("}}}")).alias("value"))
    return PL.decode_ticker(PL.landed_documents(raw)).select("pair", "price", "bid", "ask", "volume_24h", "change_24h", "change_percent_24h")


@query("iso_forms", """
SELECT id, ts AS parsed FROM ticks_t WHERE id % 5 <> 4 UNION ALL SELECT id, NULL FROM ticks_t WHERE id % 5 = 4
""")
def iso_forms(t: MarketTables) -> DataFrame:
    """times written with Z, with an offset, without one, with a blank instead of T; bad text gives none."""
    k = F.pmod("id", F.lit(5))
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    east = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(east, F.lit("+02:00"))).when(k == 2, plain)
            .when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.lit("yesterday")))
    return t.ticks.select("id", FT.parse_iso(text).alias("parsed"))


@query("pairs_explode", """
SELECT pair, wsname, altname, base, quote, status FROM pairs_t
""")
def pairs_explode(t: MarketTables) -> DataFrame:
    """AssetPairs documents (<= 100 pairs each) exploded to one row per pair."""
    doc = F.floor(F.coalesce(F.regexp_extract("pair", r"(\d+)$", 1).try_cast("bigint"), F.lit(0)) / SP.PAIRS_PER_DOC)
    return PL.decode_pairs(PL.landed_documents(SP.pair_payloads(t.pairs, doc).select("value")))


@query("iso_roundtrip", """
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, ts AS parsed FROM ticks_t
""")
def iso_roundtrip(t: MarketTables) -> DataFrame:
    """timestamps to ISO-8601 text and back."""
    iso = FT.to_iso(F.col("ts"))
    return t.ticks.select("id", iso.alias("iso"), FT.parse_iso(iso).alias("parsed"))


PAGE_LIMIT, PAGE_OFFSET = 50, 20


@query("pairs_page_meta", f"""
SELECT {PAGE_LIMIT} AS page_limit, {PAGE_OFFSET} AS page_offset,
       CAST(greatest(least({PAGE_LIMIT}, count(*) - {PAGE_OFFSET}), 0) AS BIGINT) AS returned,
       {PAGE_OFFSET} + {PAGE_LIMIT} < count(*) AS has_more, count(*) AS total
FROM pairs_t WHERE status = 'online' AND {_search_sql(COUNT_SEARCH)}
""")
def pairs_page_meta(t: MarketTables) -> DataFrame:
    """Pagination block of a filtered pair listing (returned, has_more, total)."""
    from ..operators.pairs import page_meta

    flt = t.pairs.filter(FP.status_filter("online") & FP.matches_search(COUNT_SEARCH))
    return page_meta(flt, PAGE_LIMIT, PAGE_OFFSET)
