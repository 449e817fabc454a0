"""Readers for the seven market tables.

The driver's test data is a TPC-H-like star schema; the adapters below derive the market
tables from it with column expressions, joins and aggregates only, so every table grows
with the input and every read is a pruned Parquet scan:

* symbols            <- supplier x nation x region
* market_data (1d)   <- lineitem bars per (supplier, ship date, return flag)
* ticks              <- events
* real_time_prices   <- newest tick per (symbol, source)
* pairs (metadata)   <- part
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ensure_conf

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Declared read schemas: no footer is opened to infer one, and a file that differs fails early.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Fixed creation time of adapter rows (the source tables carry none).
EPOCH_CREATED = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    reader = spark.read.schema(SOURCE_SCHEMAS[name]) if name in SOURCE_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _created() -> Column:
    return F.lit(EPOCH_CREATED).cast("timestamp")


# --------------------------------------------------------------------------- symbols
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols: one per supplier. nation (25 rows) and region (5 rows) are fixed-size
    dimensions in this schema, so broadcasting them is size-safe at any scale factor."""
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
    j = sup.join(F.broadcast(geo), sup.s_nationkey == geo.n_nationkey)
    exchanges = F.array(*[F.lit(x) for x in S.SESSION_EXCHANGES])
    asset_types = F.array(*[F.lit(x) for x in S.ASSET_TYPES])
    return j.select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("symbol"),
        F.concat_ws(" ", "s_name", "n_name").alias("name"),
        F.element_at(exchanges, (F.pmod("s_nationkey", F.lit(len(S.SESSION_EXCHANGES))) + 1).cast("int")).alias("exchange"),
        F.element_at(asset_types, (F.pmod("r_regionkey", F.lit(len(S.ASSET_TYPES))) + 1).cast("int")).alias("asset_type"),
        F.lit("USD").alias("currency"),
        F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"),
        F.round(F.col("s_acctbal") * 100).cast("bigint").alias("market_cap"),
        (F.pmod("s_suppkey", F.lit(10)) != 0).alias("is_active"),
        _created().alias("created_at"),
        _created().alias("updated_at"),
    )


# --------------------------------------------------------------------------- candles
def _bar_order() -> Column:
    """Arrival order of lines within a bar: the first line opens, the last one closes."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "px")


def market_data(spark: SparkSession, sf_dir: str, symbol_id: int | None = None) -> DataFrame:
    """Daily candles: one bar per (supplier, ship date, feed). Feed = return flag. With
    ``symbol_id`` only that symbol's, filtered at the scan (the id is a narrowing cast of the key,
    which a filter above it cannot pass).

    A single partial-aggregable groupBy (min/max/sum combine map-side), so a hot supplier is
    pre-aggregated before the shuffle. The first and the last line carry their price, which is
    shuffled once with them.
    """
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    if symbol_id is not None:
        li = li.filter(F.col("l_suppkey") == symbol_id)
    li = li.withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    bars = li.groupBy("l_suppkey", "l_shipdate", "l_returnflag").agg(
        F.min(_bar_order()).alias("first"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max(_bar_order()).alias("last"),
        F.sum("l_quantity").alias("qty"),
    ).withColumns({"open": F.col("first.px"), "close": F.col("last.px")})
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    feed_idx = F.ascii("l_returnflag").cast("bigint")
    return bars.select(
        # surrogate id: unique by construction from the bar key
        ((F.col("l_suppkey") * 100000 + days) * 256 + feed_idx).alias("id"),
        F.col("l_suppkey").cast("int").alias("symbol_id"),
        F.col("l_shipdate").cast("timestamp").alias("t_stamp"),
        "open", "high", "low", "close",
        F.rint("qty").cast("bigint").alias("volume"),
        F.col("close").alias("adjusted_close"),
        F.lit("1d").alias("time_frame"),
        F.concat(F.lit("feed_"), F.lower("l_returnflag")).alias("data_source"),
        _created().alias("created_at"),
    )


# --------------------------------------------------------------------------- ticks / prices
def ticks(spark: SparkSession, sf_dir: str, symbol_id: int | None = None) -> DataFrame:
    """Trade ticks: id, symbol_id, ts, price, size, data_source (of one symbol if given)."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    if symbol_id is not None:
        ev = ev.filter(F.col("user_id") == symbol_id)
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("int").alias("symbol_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        F.col("event_type").alias("data_source"),
    )


def tick_symbol_text(c: Column) -> Column:
    """Ticks carry a numeric instrument id; the symbol text they would arrive with."""
    return F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))


def real_time_prices(spark: SparkSession, sf_dir: str, syms: DataFrame | None = None, symbol_id: int | None = None) -> DataFrame:
    """Latest-price snapshot: newest tick per (symbol, source) of known symbols."""

    syms = syms if syms is not None else symbols(spark, sf_dir)
    tk = ticks(spark, sf_dir, symbol_id)
    known = tk.join(syms.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    order = F.struct("ts", "id")
    g = known.groupBy("symbol_id", "data_source").agg(
        F.max_by("id", order).alias("id"),
        F.max_by("price", order).alias("price"),
        F.min_by("price", order).alias("first_price"),
        F.sum("size").alias("volume_24h"),
        F.max("ts").alias("last_updated"),
        F.min("ts").alias("created_at"),
    )
    return g.select(
        "id", "symbol_id", "price",
        (F.col("price") * 0.999).alias("bid"),
        (F.col("price") * 1.001).alias("ask"),
        F.col("volume_24h").cast("bigint").alias("volume_24h"),
        (F.col("price") - F.col("first_price")).alias("change_24h"),
        F.when(F.col("first_price") > 0,
               (F.col("price") - F.col("first_price")) / F.col("first_price") * 100).alias("change_percent_24h"),
        F.lit(None).cast("bigint").alias("market_cap"),
        "data_source", "last_updated", "created_at",
    )


# --------------------------------------------------------------------------- pair metadata
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange pair metadata: pair, wsname, altname, base, quote, status. The first parts carry
    the mapped pairs' own keys; every text but the key may be missing."""
    real = F.array(*[F.lit(x) for x in S.PAIR_SYMBOL_MAP])
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    base = F.upper(F.substring_index("p_name", " ", 1))
    quote3 = F.upper(F.substring("p_type", 1, 3))
    statuses = F.array(*[F.lit(x) for x in S.PAIR_STATUSES])
    return p.select(
        F.coalesce(F.get(real, (F.col("p_partkey") - 1).cast("int")),
                   F.concat(base, quote3, F.col("p_partkey").cast("string"))).alias("pair"),
        F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat_ws("/", base, quote3)).alias("wsname"),
        F.when(F.pmod("p_partkey", F.lit(13)) == 0, F.lit(None).cast("string"))
         .when(F.pmod("p_partkey", F.lit(11)) == 0, F.lit("")).otherwise(F.col("p_brand")).alias("altname"),
        F.when(F.pmod("p_partkey", F.lit(17)) != 0, base).alias("base"),
        F.col("p_type").alias("quote"),
        F.when(F.pmod("p_partkey", F.lit(19)) != 0,
               F.element_at(statuses, (F.pmod("p_size", F.lit(4)) + 1).cast("int"))).alias("status"),
    )


#: Requests that reach the replacement map, the XBT rule, each quote suffix and the altname step.
TYPED_PAIRS = ["btc/usd", "BTC-USDT", "xbt-usdt", "doge-eur", "eth/usd", "maticeur", "BTC", "ada-usdt", "linkgbp", "brand/#12"]


def pair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair names as users type them: slashed lower-case, dashed, unknown names, and for some
    parts one of a few well-known pairs or a brand name (so these repeat)."""
    k = F.col("pair")
    form = F.pmod(F.length(k), F.lit(3))
    raw = (F.when(form == 0, F.lower(F.concat(F.substring(k, 1, 3), F.lit("/"), F.substring(k, 4, 1000))))
           .when(form == 1, F.concat(F.substring(k, 1, 2), F.lit("-"), F.substring(k, 3, 1000)))
           .otherwise(F.concat(k, F.lit("-z"))))
    part = read(spark, sf_dir, "part").select("p_partkey").filter(F.pmod("p_partkey", F.lit(25)) == 0)
    typed = F.array(*[F.lit(x) for x in TYPED_PAIRS])
    again = part.select(F.element_at(typed, (F.pmod(F.col("p_partkey") / 25, F.lit(len(TYPED_PAIRS))) + 1).cast("int")).alias("requested"))
    return pairs(spark, sf_dir).select(raw.alias("requested")).unionByName(again)


# --------------------------------------------------------------------------- seeds
def data_sources(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(S.SEED_DATA_SOURCES)]
    return spark.createDataFrame(rows, S.DATA_SOURCES)


def market_sessions(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(S.SEED_SESSIONS)]
    return spark.createDataFrame(rows, S.MARKET_SESSIONS)


def seed_market_status(spark: SparkSession, now: Column) -> DataFrame:
    """Reference seed statuses (F16): next open and close as ``now`` plus intervals."""
    rows = spark.createDataFrame(S.SEED_MARKET_STATUS, "exchange string, is_open boolean, open_hours double, trading_hours double")
    after = lambda h: now + F.make_dt_interval(F.lit(0), F.lit(0), F.round(h * 60).cast("int"))
    return rows.select("exchange", "is_open", after(F.col("open_hours")).alias("next_open"),
                       after(F.col("open_hours") + F.col("trading_hours")).alias("next_close"), now.alias("last_updated"))


def seed_symbols(spark: SparkSession) -> DataFrame:
    """Reference seed symbols as incoming rows (is_active left to the default)."""
    schema = ("symbol string, name string, exchange string, asset_type string, currency string, "
              "sector string, industry string, market_cap bigint")
    return spark.createDataFrame(S.SEED_SYMBOLS, schema).withColumn("is_active", F.lit(None).cast("boolean"))
