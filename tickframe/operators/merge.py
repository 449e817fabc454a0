"""Writes and merges (U1-U10, S12-S13) on plain Parquet tables.

Parquet has no MERGE/UPDATE/DELETE, so each operation is "read -> join -> new table":
the functions below return the merged table as a DataFrame (no action), and
``publish`` writes it to a fresh path under the shared checkpoint folder, touching only
the partitions present in the output (dynamic partition overwrite). A table is never
overwritten in place while it is being read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import PARQUET, discard, scratch, staged, staging_path

CANDLE_KEY = ["symbol_id", "t_stamp", "time_frame", "data_source"]
PRICE_KEY = ["symbol_id", "data_source"]
PRICE_FIELDS = ["price", "bid", "ask", "volume_24h", "change_24h", "change_percent_24h", "market_cap"]


# --------------------------------------------------------------------------- ids
def assign_ids(new_rows: DataFrame, key: list[str], base: Column | int = 0, id_col: str = "id",
               buckets: int = 1024) -> DataFrame:
    """Dense ids ``base+1 .. base+n`` for ``new_rows``, deterministic from the key values.

    No single-partition window: rows are numbered inside ``buckets`` hash buckets of the key
    (one parallel window per bucket), and each bucket's offset comes from a prefix sum over
    the per-bucket counts (``buckets`` rows: a fixed, broadcast-safe size).
    """
    b = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    tagged = new_rows.withColumn("_b", b)
    counts = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_b", F.coalesce("_off", F.lit(0)).alias("_off"))
    w = Window.partitionBy("_b").orderBy(*key)
    base_c = base if isinstance(base, Column) else F.lit(base)
    return (tagged.join(F.broadcast(offs), "_b")
            .withColumn(id_col, (base_c + F.col("_off") + F.row_number().over(w)).cast("bigint"))
            .drop("_b", "_off"))


def max_id(df: DataFrame, id_col: str = "id") -> Column:
    """Scalar subquery-free max id as a literal (one aggregate row, read on the driver)."""
    v = df.agg(F.max(id_col)).first()[0]
    return F.lit(int(v or 0))


# --------------------------------------------------------------------------- U1 insert-ignore
def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


def first_per_key(df: DataFrame, key: list[str], order: list[str], newest: bool = False, drop: list[str] | None = None) -> DataFrame:
    """Keep one row per key: the first by ``order`` (or the last with ``newest=True``), without the columns ``drop``.

    A min/max (or min_by/max_by) aggregate, so duplicates combine map-side before the shuffle and a key
    holding a large share of the rows never has to be sorted or buffered in one task.
    """
    others = [c for c in df.columns if c not in key and c not in (drop or [])]
    if set(order) == set(others) and all(_orderable(df.schema[c].dataType) for c in others):
        one = F.struct(*dict.fromkeys(order))  # the order is the row: each value is shuffled and kept once
        picked = F.max(one) if newest else F.min(one)
    else:
        picked = (F.max_by if newest else F.min_by)(F.struct(*others), F.struct(*order))
    g = df.groupBy(*key).agg(picked.alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*[c for c in df.columns if c in key or c in others])


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO NOTHING. Returns only the rows to append."""
    fresh = first_per_key(incoming, key, order)
    return fresh.join(target.select(*key), key, "left_anti")


def merge_counts(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """A5: fetched, unique_keys and inserted of an insert-ignore merge. Every row is tagged once and
    counted per key in one shuffle (counts combine map-side)."""
    tagged = incoming.select(*key, F.lit(1).alias("_in"), F.lit(0).alias("_has")).unionByName(
        target.select(*key, F.lit(0).alias("_in"), F.lit(1).alias("_has")))
    per_key = tagged.groupBy(*key).agg(F.sum("_in").alias("n"), F.max("_has").alias("has"))
    one = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("fetched"), F.count_if(F.col("n") > 0).alias("unique_keys"),
                      F.count_if((F.col("n") > 0) & (F.col("has") == 0)).alias("inserted"))
    return one.unpivot([], ["fetched", "unique_keys", "inserted"], "metric", "value")


def insert_ignore_table(target: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """U1 as the resulting table (target plus the appended rows)."""
    return target.unionByName(insert_ignore(target, incoming, key, order).select(*target.columns))


# --------------------------------------------------------------------------- U2 upsert
def upsert_prices(target: DataFrame, incoming: DataFrame, now: Column | None = None, assign_missing: bool | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (symbol_id, data_source) DO UPDATE.

    The incoming row replaces all seven value fields (NULLs overwrite too) and sets
    last_updated; id and created_at of an existing row are kept. Several incoming rows per
    key: the newest (last_updated, then the other fields) wins. One full outer join on the
    key. Incoming rows need no id (decoded tickers have none): with ``assign_missing`` (default:
    where ``incoming`` has no id column) inserted rows without one get ids above all known ones.
    """
    assign_missing = "id" not in incoming.columns if assign_missing is None else assign_missing
    if "id" not in incoming.columns:
        incoming = incoming.withColumn("id", F.lit(None).cast("bigint"))
    inc = first_per_key(incoming, PRICE_KEY, ["last_updated", "id", *PRICE_FIELDS], newest=True).withColumn("_hit", F.lit(True))
    t = target.alias("t")
    i = inc.alias("i")
    j = t.join(i, PRICE_KEY, "full_outer")
    hit = F.col("i._hit").isNotNull()
    cols = [F.coalesce(F.col("t.id"), F.col("i.id")).alias("id"), *[F.col(k) for k in PRICE_KEY]]
    for c in PRICE_FIELDS:
        cols.append(F.when(hit, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    stamp = now if now is not None else F.col("i.last_updated")
    cols.append(F.when(hit, stamp).otherwise(F.col("t.last_updated")).alias("last_updated"))
    cols.append(F.coalesce(F.col("t.created_at"), F.col("i.created_at")).alias("created_at"))
    cols.append(F.when(F.col("t.id").isNull(), F.lit("insert"))
                .when(hit, F.lit("update")).otherwise(F.lit("keep")).alias("action"))
    merged = j.select(*cols)
    if not assign_missing:
        return merged
    base = max_id(target.select("id").unionByName(incoming.select("id")))
    fresh = assign_ids(merged.filter(F.col("id").isNull()).drop("id"), PRICE_KEY, base=base)
    return merged.filter(F.col("id").isNotNull()).unionByName(fresh.select(*merged.columns))


# --------------------------------------------------------------------------- U3 / U4 / U5 symbols
def symbol_defaults(df: DataFrame) -> DataFrame:
    """Currency USD, is_active true when not given."""
    return (df.withColumn("currency", F.coalesce(F.col("currency"), F.lit("USD")))
              .withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True))))


def create_symbols(symbols: DataFrame, incoming: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Create symbols with defaults; the symbol text is unique.

    Returns (created rows with fresh ids, rejected rows with a reason). A NULL in a NOT NULL
    column, a text over its declared length, a symbol already in the table or one repeated
    inside the batch is rejected (the reference raises). Of the valid rows of one new symbol
    exactly one is created, the least by (name, exchange, other columns); equal rows are
    counted together before the shuffle, so one symbol may hold any share of the batch.
    """
    now = now if now is not None else F.current_timestamp()
    inc = symbol_defaults(incoming)
    fault = F.lit(None).cast("string")
    for name, n in reversed(S.SYMBOL_LENGTHS.items()):
        if name in incoming.columns:
            fault = F.when(F.length(name) > n, F.lit(f"{name}_too_long")).otherwise(fault)
    for name in reversed(S.NOT_NULL["symbols"]):
        fault = F.when(F.col(name).isNull(), F.lit(f"{name}_missing")).otherwise(fault)
    others = ["name", "exchange", *[c for c in inc.columns if c not in ("symbol", "name", "exchange")]]
    rows = inc.groupBy(*inc.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_fault", fault)
    firsts = (rows.filter(F.col("_fault").isNull()).groupBy("symbol").agg(F.min(F.struct(*others)).alias("_first"))
              .withColumnRenamed("symbol", "_symbol"))
    existing = symbols.select(F.col("symbol").alias("_known"))
    tagged = (rows.join(firsts, F.col("symbol") == F.col("_symbol"), "left").join(existing, F.col("symbol") == F.col("_known"), "left")
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))))
    first = F.struct(*others).eqNullSafe(F.col("_first")) & (F.col("_copy") == 1)
    reason = (F.when(F.col("_fault").endswith("_missing"), F.col("_fault"))
              .when(F.col("_known").isNotNull(), F.lit("duplicate_symbol"))
              .when(F.col("_fault").isNotNull(), F.col("_fault"))
              .when(~first, F.lit("duplicate_in_batch")))
    tagged = tagged.select(*inc.columns, reason.alias("reason"))
    ok = tagged.filter(F.col("reason").isNull()).drop("reason")
    ok = assign_ids(ok, ["symbol"], base=max_id(symbols), id_col="id").withColumn("id", F.col("id").cast("int"))
    for c in ["sector", "industry"]:
        if c not in ok.columns:
            ok = ok.withColumn(c, F.lit(None).cast("string"))
    if "market_cap" not in ok.columns:
        ok = ok.withColumn("market_cap", F.lit(None).cast("bigint"))
    ok = ok.withColumn("created_at", now).withColumn("updated_at", now)
    return ok.select(*S.SYMBOLS.fieldNames()), tagged.filter(F.col("reason").isNotNull())


UPDATE_FIELDS = ["name", "sector", "industry", "market_cap"]


def update_symbols(symbols: DataFrame, changes: DataFrame, now: Column | None = None,
                   replace: bool = False, fields: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """U4: apply a batch of changes keyed by symbol; several changes of one symbol: the last by
    ``order`` (columns of ``changes``; default: by the changed values) is applied.

    Default is patch semantics (a NULL/missing field keeps the old value). ``replace=True``
    is the reference's form: all four of name, sector, industry, market_cap are written and
    missing ones become NULL. ``is_active`` is applied when the change carries it.
    """
    now = now if now is not None else F.current_timestamp()
    fields = fields or UPDATE_FIELDS + (["is_active"] if "is_active" in changes.columns else [])
    given = [c for c in fields if c in changes.columns]
    last = first_per_key(changes.select("symbol", *dict.fromkeys([*given, *(order or [])])), ["symbol"], order or given, newest=True)
    ch = last.select("symbol", *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    j = symbols.join(ch, "symbol", "left")
    out = []
    for c in symbols.columns:
        if c in fields:
            new = F.col(f"_new_{c}") if f"_new_{c}" in j.columns else F.lit(None)
            val = new if (replace and c in UPDATE_FIELDS) else F.coalesce(new, F.col(c))
            out.append(F.when(F.col("_hit"), val).otherwise(F.col(c)).cast(symbols.schema[c].dataType).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_symbols(symbols: DataFrame, predicate: Column, **children: DataFrame) -> dict[str, DataFrame]:
    """U5 + J10: delete matching symbols and cascade to child tables keyed by symbol_id."""
    gone = symbols.filter(predicate).select("id")
    out = {"symbols": symbols.filter(~predicate | predicate.isNull())}
    if children:
        ids = gone.select(F.col("id").alias("symbol_id"))
        for name, df in children.items():
            out[name] = df.join(ids, "symbol_id", "left_anti")
    return out


# --------------------------------------------------------------------------- storage edge
def to_storage(df: DataFrame, table: str) -> DataFrame:
    """Cast compute doubles to the declared decimal precision at write time."""
    if table == "market_data":
        dec = {c: S.D20_8 for c in ["open", "high", "low", "close", "adjusted_close"]}
    elif table == "real_time_prices":
        dec = {c: S.D20_8 for c in ["price", "bid", "ask", "change_24h"]}
        dec["change_percent_24h"] = S.D10_4
    elif table == "technical_indicators":
        dec = {c: (S.D10_4 if c in S.INDICATOR_D10_4 else S.D20_8)
               for c in S.INDICATOR_COLUMNS if c != "volume_sma_20"}
    else:
        dec = {}
    return df.select(*[F.col(c).cast(dec[c]).alias(c) if c in dec else F.col(c) for c in df.columns])


def with_year_month(df: DataFrame, ts_col: str = "t_stamp") -> DataFrame:
    """Monthly range partition key, YYYY-MM of the timestamp."""
    return df.withColumn("year_month", F.date_format(F.col(ts_col), "yyyy-MM"))


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Write ``df`` as Parquet. Overwrite replaces only the partitions present in ``df``
    (dynamic partition overwrite, set on this write only). Rows are clustered by partition
    and sorted by (symbol_id, t_stamp) within files, so min/max statistics skip row groups
    for point and range reads."""
    w = df
    writer_opts = {"partitionOverwriteMode": "dynamic", **PARQUET}
    if partition_by:
        sort_cols = [c for c in ["symbol_id", "t_stamp"] if c in df.columns]
        w = df.hint("rebalance", *partition_by)  # AQE splits a large month over tasks and files
        if sort_cols:
            w = w.sortWithinPartitions(*partition_by, *sort_cols)
        w.write.options(**writer_opts).mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        w.write.options(**writer_opts).mode(mode).parquet(path)
    return path


def write_candles(candles: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One bulk write, partitioned by (time_frame, year_month)."""
    return publish(to_storage(with_year_month(candles), "market_data"), path, ["time_frame", "year_month"], mode)


def write_bucketed(candles: DataFrame, table: str, path: str, buckets: int = 16) -> DataFrame:
    """The candle table as a catalog table, partitioned by time frame and month, and in each partition
    bucketed and sorted by symbol: joins and groupings by ``symbol_id`` of what it scans shuffle nothing."""
    rows = to_storage(with_year_month(candles), "market_data")
    (rows.repartition(buckets, "symbol_id").write.mode("overwrite").option("path", path).partitionBy("time_frame", "year_month")
     .bucketBy(buckets, "symbol_id").sortBy("symbol_id", "t_stamp").saveAsTable(table))
    return candles.sparkSession.table(table)


def stored_schema(table: str):
    """Storage schema (declared decimals, partition columns as strings) of a stored table."""
    from pyspark.sql import types as T

    base = {"market_data": S.MARKET_DATA, "real_time_prices": S.REAL_TIME_PRICES,
            "technical_indicators": S.TECHNICAL_INDICATORS}[table]
    probe = to_storage(SparkSession.getActiveSession().createDataFrame([], base), table).schema
    fields = list(probe.fields)
    if table == "market_data":
        fields.append(T.StructField("year_month", T.StringType(), True))
    return T.StructType(fields)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """S2 over the stored table, read with its declared schema: partition values keep their
    string type (no inference, so time frame "1d" stays text) and become pruning filters."""
    return spark.read.schema(stored_schema("market_data")).parquet(path)


def existing(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path`` read with its declared schema (no footer is opened for it), or None where
    nothing has been written. Any other failure to read is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def existing_candles(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored candle table at ``path``, or None where nothing has been written."""
    return existing(spark, path, stored_schema("market_data"))


# --------------------------------------------------------------------------- ids of a stored table
def reserve_ids(spark: SparkSession, path: str, n: int, id_col: str = "id") -> int:
    """The greatest id handed out so far for the table at ``path``; the next ``n`` are taken.

    The ids handed out are written down beside the table before any row is, so a batch neither reads
    the ids of stored rows nor, after a crash between the two writes, hands an id out twice. A table
    without such a record (written by other means) is asked for its greatest id once.
    """
    record = f"{path.rstrip('/')}_ids"
    known = existing(spark, record, "high bigint")
    high = known.agg(F.max("high")).first()[0] if known is not None else None
    if high is None:
        table = existing(spark, path, f"{id_col} bigint")
        high = (table.agg(F.max(id_col)).first()[0] if table is not None else None) or 0
    if n:
        spark.range(1).select(F.lit(high + n).cast("bigint").alias("high")).coalesce(1).write.mode("append").parquet(record)
    return high


# --------------------------------------------------------------------------- U6 / U7 / U9 pair-driven writes
def sync_plan(mapping: DataFrame, pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """One diff of mapped pairs against the symbols table.

    mapping (pair, db_symbol) semi-joined to the exchange metadata, left-joined to symbols:
    action = create (no such symbol) / update (is_active differs from status == 'online') /
    none. The reference's update call never writes is_active; this plan carries the value
    so ``apply_sync`` really sets it.
    """
    from ..functions.pairs import is_online

    m = mapping.join(pairs.select("pair", "altname", "status"), "pair")
    s = symbols.select(F.col("symbol").alias("db_symbol"), F.col("is_active").alias("_cur"),
                                       F.lit(True).alias("_exists"))
    j = m.join(s, "db_symbol", "left")
    want = is_online(F.col("status"))
    action = (F.when(F.col("_exists").isNull(), F.lit("create"))
              .when(~F.col("_cur").eqNullSafe(want), F.lit("update"))
              .otherwise(F.lit("none")))
    return j.select("pair", "db_symbol", F.coalesce("altname", "db_symbol").alias("name"),
                    want.alias("is_active"), action.alias("action"))


def apply_sync(plan: DataFrame, symbols: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply a sync plan: create missing symbols, set is_active on the changed ones."""
    creates = plan.filter(F.col("action") == "create").select(
        F.col("db_symbol").alias("symbol"), "name", F.lit(S.EXCHANGE_NAME).alias("exchange"),
        F.lit("crypto").alias("asset_type"), F.lit("USD").alias("currency"), "is_active")
    created, _ = create_symbols(symbols, creates, now)
    changes = plan.filter(F.col("action") == "update").select(F.col("db_symbol").alias("symbol"), "is_active")
    updated = update_symbols(symbols, changes, now, fields=["is_active"])
    return updated.unionByName(created)


def add_pairs_plan(requests: DataFrame, pairs: DataFrame, symbols: DataFrame, col: str = "requested") -> DataFrame:
    """Normalise -> infer symbol -> offered? -> exists? -> create, for a batch of requests.

    A ``db_symbol`` column of ``requests`` overrides the inferred symbol where it is given. Of the
    requests for one new symbol that the exchange offers exactly one (the least by request text)
    creates it, the rest are ``duplicate_in_batch``; equal requests are counted together first.
    """
    from ..functions.pairs import currency_of, infer_symbol, is_online, normalize_pair

    given = F.col("db_symbol") if "db_symbol" in requests.columns else F.lit(None).cast("string")
    r = (requests.select(col, given.alias("_given")).groupBy(col, normalize_pair(F.col(col)).alias("normalized"), "_given")
         .agg(F.count(F.lit(1)).alias("_n")))
    # grouped again (no further shuffle), so that the joins below see a column, not the expression
    r = (r.withColumn("db_symbol", F.coalesce("_given", infer_symbol(F.col("normalized"))))
         .groupBy(col, "normalized", "_given", "db_symbol").agg(F.sum("_n").alias("_n")))
    p = pairs.select(F.col("pair").alias("normalized"), "altname", "status", F.lit(True).alias("_offered"))
    s = symbols.select(F.col("symbol").alias("db_symbol"), F.lit(True).alias("_exists"))
    j = r.join(p, "normalized", "left").join(s, "db_symbol", "left")
    firsts = (j.filter(F.col("_offered") & F.col("_exists").isNull()).groupBy("db_symbol")
              .agg(F.min(F.struct(col, "normalized")).alias("_first")))  # one row per (request, given symbol)
    j = j.join(firsts, "db_symbol", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    first = (F.struct(col, "normalized") == F.col("_first")) & (F.col("_copy") == 1)
    action = (F.when(F.col("_offered").isNull(), F.lit("not_found"))
              .when(F.col("_exists").isNotNull(), F.lit("exists"))
              .when(first, F.lit("create"))
              .otherwise(F.lit("duplicate_in_batch")))
    return j.select(col, "normalized", "db_symbol", action.alias("action"),
                    F.coalesce("altname", "db_symbol").alias("name"),
                    currency_of(F.col("db_symbol")).alias("currency"),
                    is_online(F.col("status")).alias("is_active"))


def add_pairs(requests: DataFrame, pairs: DataFrame, symbols: DataFrame, tickers: DataFrame, prices: DataFrame,
              now: Column | None = None, col: str = "requested") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The add-pair plan carried out: its symbols are created, and each gets the price of its pair's
    ticker (decoded, keyed by ``pair``) where there is a valid one.

    Returns (plan, symbols table, price table with an ``action`` column). The plan is written once, so that
    symbols and prices rest on the same decisions; requests that create nothing change nothing.
    """
    from .reads import validate_prices

    now = now if now is not None else F.current_timestamp()
    plan = staged(add_pairs_plan(requests, pairs, symbols, col), "add-pairs", keep=True)
    wanted = plan.filter(F.col("action") == "create").select(
        F.col("db_symbol").alias("symbol"), "name", F.lit(S.EXCHANGE_NAME).alias("exchange"),
        F.lit("crypto").alias("asset_type"), "currency", "is_active")
    created = staged(create_symbols(symbols, wanted, now)[0], "new-symbols", keep=True)
    seeds = (validate_prices(tickers)[0].join(plan.filter(F.col("action") == "create").select(F.col("normalized").alias("pair"), "db_symbol"), "pair")
             .join(created.select(F.col("symbol").alias("db_symbol"), F.col("id").alias("symbol_id")), "db_symbol"))
    rows = seeds.select(F.lit(None).cast("bigint").alias("id"), "symbol_id", *[c for c in PRICE_FIELDS if c != "market_cap"],
                        F.lit(None).cast("bigint").alias("market_cap"), "data_source", now.alias("last_updated"), now.alias("created_at"))
    return plan, symbols.unionByName(created), upsert_prices(prices, staged(rows, "new-prices", keep=True), assign_missing=True)


def new_symbols(texts: DataFrame, symbols: DataFrame, now: Column | None = None) -> DataFrame:
    """A new symbols row for each ``symbol`` of ``texts`` that ``symbols`` lacks."""
    lacking = texts.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti").select(
        "symbol", F.col("symbol").alias("name"), F.lit(S.EXCHANGE_NAME).alias("exchange"),
        F.lit("crypto").alias("asset_type"), F.lit("USD").alias("currency"), F.lit(True).alias("is_active"))
    return create_symbols(symbols, lacking, now)[0]


def get_or_create_symbols(texts: DataFrame, symbols: DataFrame, now: Column | None = None) -> DataFrame:
    """The symbols table with the new rows; these alone are written, so that their ids are decided once."""
    return symbols.unionByName(staged(new_symbols(texts, symbols, now), "new-symbols", keep=True))


def touched(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a stored candle table in the (time_frame, year_month) partitions that ``batch`` touches.

    The month list is joined, so Spark prunes the other partitions when it runs the scan.
    """
    months = batch.select("time_frame", "year_month").distinct()
    return table.join(months, ["time_frame", "year_month"], "left_semi")


#: Columns that order the copies of a candle key by arrival, where a batch carries them.
ARRIVAL = ["arrival", "slot"]


def ingest_ohlc(decoded: DataFrame, symbols: DataFrame, path: str, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded candles -> validation -> mapped symbol (F2) -> get-or-create symbols ->
    insert-ignore into the stored candle table at ``path``.

    Of several rows of one key in the batch the first to arrive is stored: by ``arrival`` (a delivery's
    time, file and row, see ``read_arrivals``) and ``slot`` (place in a document); a batch without these
    columns has no arrival order, there the least by value is taken. Appended rows get ids and
    created_at; volume defaults to 0. The batch is decoded and checked once, and of what is written on the way
    only the new symbols and the quarantine stay; only the partitions that it touches are read back. Returns (symbols with the created ones, quarantined rows with reasons,
    counts as metric and value: fetched, inserted, quarantined). A rerun appends nothing.
    """
    from ..functions.pairs import pair_to_symbol
    from .reads import candle_violations

    now = now if now is not None else F.current_timestamp()
    spark = decoded.sparkSession
    tagged = (decoded.withColumn("volume", F.coalesce("volume", F.lit(0).cast("bigint")))
              .withColumn("db_symbol", pair_to_symbol(F.col("pair"))).withColumn("violations", candle_violations()))
    seen, added = Observation(), Observation()
    with scratch(spark):
        at = staging_path(spark, "ohlc-batch")
        batch = staged(tagged.observe(seen, F.count(F.lit(1)).alias("fetched"), F.count_if(F.size("violations") > 0).alias("quarantined")), "ohlc-batch", path=at)
        bad = staged(batch.filter(F.size("violations") > 0), "ohlc-quarantine", keep=True)
        valid = batch.filter(F.size("violations") == 0)
        allsym = get_or_create_symbols(valid.select(F.col("db_symbol").alias("symbol")), symbols, now)
        rows = with_year_month(valid.join(allsym.select(F.col("symbol").alias("db_symbol"), F.col("id").alias("symbol_id")), "db_symbol"))
        order = [c for c in ARRIVAL if c in decoded.columns]
        rows = rows.select("symbol_id", "t_stamp", "open", "high", "low", "close", "volume", "adjusted_close", "time_frame",
                           "data_source", "year_month", *order)
        stored = existing_candles(spark, path)
        fresh = first_per_key(rows, CANDLE_KEY, order or ["open", "high", "low", "close", "volume"], drop=order)
        if stored is not None:
            fresh = fresh.join(touched(stored, rows).select(*CANDLE_KEY), CANDLE_KEY, "left_anti")
        fresh = staged(fresh.observe(added, F.count(F.lit(1)).alias("inserted")), "ohlc-fresh")
        discard(spark, at)
        counts = {**seen.get, **added.get}
        fresh = assign_ids(fresh, CANDLE_KEY, base=reserve_ids(spark, path, counts["inserted"])).withColumn("created_at", now)
        write_candles(fresh.select(*S.MARKET_DATA.fieldNames()), path, mode="append")
    return allsym, bad, spark.createDataFrame([(m, counts[m]) for m in ("fetched", "inserted", "quarantined")], "metric string, value bigint")


def ingest_tickers(decoded: DataFrame, symbols: DataFrame, prices: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded tickers -> validation -> get-or-create symbols -> price upsert.

    Returns (symbols with the created ones, quarantined rows with reasons, the price table with
    an ``action`` column).
    """
    from ..functions.pairs import pair_to_symbol
    from .reads import validate_prices

    now = now if now is not None else F.current_timestamp()
    valid, bad = validate_prices(decoded.withColumn("db_symbol", pair_to_symbol(F.col("pair"))))
    allsym = get_or_create_symbols(valid.select(F.col("db_symbol").alias("symbol")), symbols, now)
    rows = valid.join(allsym.select(F.col("symbol").alias("db_symbol"), F.col("id").alias("symbol_id")), "db_symbol").select(
        F.lit(None).cast("bigint").alias("id"), "symbol_id", "price", "bid", "ask", "volume_24h", "change_24h", "change_percent_24h",
        F.lit(None).cast("bigint").alias("market_cap"), "data_source", now.alias("last_updated"), now.alias("created_at"))
    return allsym, bad, upsert_prices(prices, rows, assign_missing=True)
