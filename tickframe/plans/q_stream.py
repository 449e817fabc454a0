"""Registered streaming queries (T1-T6): each runs a stream over a landing folder derived
from the input tables (trigger availableNow) and returns the sink's contents. Oracles are
the equivalent batch results restricted to what the final watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..session import discard, fresh_path
from ..sources.catalog import MarketTables
from ..streaming import streams as ST
from .q_indicators import indicator_sql
from .q_pairs import _OHLC_PAIR_SQL
from .registry import query

TICK_CHUNKS = 6
BAR_CHUNKS = 7
#: Files of a delivery; a trigger reads them all, each in its own task.
FILES = 2


def _tick_landing(t: MarketTables, extra: DataFrame | None = None) -> str:
    path = fresh_path(t.spark, "landing-ticks")
    src = t.ticks if extra is None else t.ticks.unionByName(extra)
    return ST.land_in_order(src, "ts", path, TICK_CHUNKS, files=FILES)


def _late_copy(t: MarketTables, id_shift: int = 0) -> DataFrame:
    first = t.ticks.agg(F.min("ts")).first()[0]
    late = t.ticks.filter(F.col("ts") < F.lit(first) + F.expr("INTERVAL 1 DAY"))
    return late.withColumn("id", F.col("id") + id_shift)


@query("stream_prices", """
SELECT symbol_id, data_source, arg_max(id, (ts, id)) AS id, arg_max(ts, (ts, id)) AS ts,
       arg_max(price, (ts, id)) AS price, arg_max(size, (ts, id)) AS size
FROM ticks_t GROUP BY symbol_id, data_source
""")
def stream_prices(t: MarketTables) -> DataFrame:
    """Tick stream -> latest price per (symbol, source), upserted per micro-batch."""
    land = _tick_landing(t)
    sink = ST.VersionedUpsert(t.spark, fresh_path(t.spark, "stream-prices"), ["symbol_id", "data_source"], ["ts", "id"])
    ST.run_foreach_batch(ST.latest_prices_stream(ST.read_landing(t.spark, land, ST.TICK_SCHEMA, FILES)), "stream-prices", sink)
    return sink.table().select("symbol_id", "data_source", "id", "ts", "price", "size")


_CLOSED_1H = """
SELECT symbol_id, data_source, date_trunc('hour', ts) AS t_stamp,
       arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close,
       CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades
FROM ticks_t GROUP BY symbol_id, data_source, date_trunc('hour', ts)
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks_t) - INTERVAL 10 MINUTE"""


@query("stream_candles", _CLOSED_1H)
def stream_candles(t: MarketTables) -> DataFrame:
    """Hourly candles with a 10-minute watermark; only closed windows are emitted."""
    land = _tick_landing(t)
    sink, _ = ST.run_to_files(ST.candles_stream(ST.read_landing(t.spark, land, ST.TICK_SCHEMA, FILES)), "stream-candles")
    return t.spark.read.parquet(sink)


@query("stream_dedup", """
SELECT id, symbol_id, ts, price, size, data_source FROM ticks_t
""")
def stream_dedup(t: MarketTables) -> DataFrame:
    """Re-delivered ticks (in-batch copies and a late re-send) suppressed on the tick key."""
    copies = t.ticks.filter(F.pmod("id", F.lit(4)) == 0)
    land = _tick_landing(t, copies)
    _late_copy(t).coalesce(1).write.mode("append").parquet(land)
    root = fresh_path(t.spark, "stream-dedup")
    sink = ST.InsertIgnoreSink(t.spark, root, ["id"], "ts", 3600)
    ST.run_foreach_batch(ST.dedup_stream(ST.read_landing(t.spark, land, ST.TICK_SCHEMA, FILES), ["id"]),
                         "stream-dedup", sink, mode="append")
    return sink.table()


#: Files of the late re-send: the count of late rows doesn't depend on them.
LATE_FILES = 4


@query("stream_late", f"""
SELECT 'late_rows' AS metric, count(*) AS value FROM ticks_t WHERE ts < (SELECT min(ts) FROM ticks_t) + INTERVAL 1 DAY
UNION ALL SELECT 'windows_emitted', count(*) FROM ({_CLOSED_1H})
UNION ALL SELECT 'rows_read', (SELECT count(*) FROM ticks_t) + (SELECT count(*) FROM ticks_t WHERE ts < (SELECT min(ts) FROM ticks_t) + INTERVAL 1 DAY)
""")
def stream_late(t: MarketTables) -> DataFrame:
    """T4: a late re-send of the first day is dropped past the watermark and its rows are counted: those
    read, less those in closed windows and in windows still open."""
    read, late, emitted = late_candles(t, LATE_FILES)
    return (emitted.agg(F.count(F.lit(1)).alias("value")).select(F.lit("windows_emitted").alias("metric"), "value")
            .unionByName(t.spark.createDataFrame([("late_rows", late), ("rows_read", read)], "metric string, value bigint")))


def late_candles(t: MarketTables, files: int) -> tuple[int, int, DataFrame]:
    """(rows read, rows too late, closed windows) of the hourly candles when the first day comes again in ``files`` files."""
    land = _tick_landing(t)
    _late_copy(t, 10 ** 12).repartition(files).write.mode("append").parquet(land)
    seen = ST.WatermarkDrops(t.spark)
    sink, q, checkpoint = ST.run_to_files(ST.candles_stream(ST.counted(ST.read_landing(t.spark, land, ST.TICK_SCHEMA, FILES))), "stream-late", keep=True)
    read, closed = seen.rows(q), t.spark.read.parquet(sink)
    return read, ST.late_rows(t.spark, read, closed, checkpoint), closed


@query("stream_24h", """
WITH w AS (
  SELECT t.*, date_trunc('hour', t.ts) - to_hours(CAST(k AS BIGINT)) AS window_start
  FROM ticks_t t, range(0, 24) r(k))
SELECT symbol_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, CAST(sum(size) AS BIGINT) AS volume_24h,
       arg_min(price, (ts, id)) AS first_price, arg_max(price, (ts, id)) AS last_price,
       arg_max(price, (ts, id)) - arg_min(price, (ts, id)) AS change_24h, count(*) AS trades
FROM w GROUP BY symbol_id, window_start
HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM ticks_t) - INTERVAL 10 MINUTE
""")
def stream_24h(t: MarketTables) -> DataFrame:
    """T5: 24 h volume and price change per symbol, sliding hourly, closed windows only."""
    land = _tick_landing(t)
    sink, _ = ST.run_to_files(ST.rolling_24h_stream(ST.read_landing(t.spark, land, ST.TICK_SCHEMA, FILES)), "stream-24h")
    return t.spark.read.parquet(sink)


def _ema_oracle() -> str:
    body = indicator_sql(["ema_12", "ema_26", "rsi_14"], True)
    return body.replace(
        "SELECT symbol_id, t_stamp AS timestamp, time_frame, ema_12, ema_26, rsi_14 FROM wd JOIN ri USING (symbol_id, time_frame, rn)",
        "SELECT symbol_id, time_frame, t_stamp, ema_12, ema_26, rsi_14 FROM wd JOIN ri USING (symbol_id, time_frame, rn) "
        "WHERE t_stamp <= (SELECT max(t_stamp) FROM bars)")


@query("stream_ema", _ema_oracle())
def stream_ema(t: MarketTables) -> DataFrame:
    """Incremental EMA12/EMA26/RSI14 per series from a bar stream, state per series;
    bars are released in event-time order once the watermark passes them."""
    bars = I.series_bars(t.candles).select("symbol_id", "time_frame", "t_stamp", "close")
    land = fresh_path(t.spark, "landing-bars")
    ST.land_in_order(bars, "t_stamp", land, BAR_CHUNKS, files=FILES)
    stream = ST.read_landing(t.spark, land, "symbol_id int, time_frame string, t_stamp timestamp, close double", FILES)
    sink, _ = ST.run_to_files(ST.ema_stream(stream), "stream-ema")
    return t.spark.read.parquet(sink)


@query("stream_ohlc_ingest", """
SELECT 'S' || CAST(symbol_id AS VARCHAR) || '-' || data_source AS pair, t_stamp, open, high, low, close,
       CAST(round_even(CAST(volume AS DOUBLE), 0) AS BIGINT) AS volume, close AS adjusted_close,
       '1d' AS time_frame, 'kraken' AS data_source
FROM candles_t
""")
def stream_ohlc_ingest(t: MarketTables) -> DataFrame:
    """Exchange OHLC documents landed as text files in fetch order, odd months
    fetched twice; the stream decodes them, drops re-sent bars on the candle key within
    the watermark and appends with insert-ignore per micro-batch."""
    from ..sources import payloads as SP
    from .q_pairs import _ohlc_pair

    docs = SP.ohlc_payloads(t.candles, _ohlc_pair())
    docs = docs.withColumn("doc_ts", F.to_timestamp(F.concat("ym", F.lit("-01"))))
    times = F.when(F.substring("ym", 6, 2).cast("int") % 2 == 1, 2).otherwise(1)
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))  # the documents are made once
    land, checkpoint = fresh_path(t.spark, "landing-ohlc"), fresh_path(t.spark, "stream-ohlc-ckpt")
    root = fresh_path(t.spark, "stream-ohlc")
    sink = ST.InsertIgnoreSink(t.spark, root, ST.OHLC_KEY, "t_stamp", 62 * 86400, order=["arrival", "slot"])
    for _ in ST.deliveries(docs, "doc_ts", land, BAR_CHUNKS, fmt="text", files=FILES):
        ST.run_foreach_batch(ST.ohlc_document_stream(t.spark, land, "1d", FILES), "stream-ohlc", sink, mode="append", checkpoint=checkpoint)
        discard(t.spark, land)  # texts take several times the room of what the table keeps of them
    return sink.table()


_STREAM_TICKER_NOW = "2024-02-01 00:00:00"


@query("stream_tickers", f"""
WITH p AS (SELECT *, {_OHLC_PAIR_SQL} AS pair FROM prices_t)
SELECT pair AS db_symbol, 'kraken' AS data_source, symbol_id % 3 = 2 AS in_third_epoch,
       CASE WHEN symbol_id % 3 = 0 THEN price + 2 WHEN symbol_id % 3 = 1 THEN price + 1 ELSE price + 3 END AS price, 1 AS rows_of_symbol
FROM p
""")
def stream_tickers(t: MarketTables) -> DataFrame:
    """Streamed ticker documents -> latest prices, symbols created as they appear. Deliveries:
    all but every third symbol, one third again, then the symbols that weren't there before; the second
    and third epoch are run twice, as after a lost driver."""
    from ..sources import payloads as SP
    from .q_pairs import _ohlc_pair

    part = F.pmod("symbol_id", F.lit(3))
    prices = t.prices.withColumn("change_24h", F.lit(None).cast("double"))
    land = fresh_path(t.spark, "landing-tickers")
    for which, plus in ((part < 2, 1.0), (part == 0, 2.0), (part == 2, 3.0)):
        some = prices.filter(which).withColumn("price", F.col("price") + plus)
        SP.ticker_payloads(some, _ohlc_pair()).select("value").coalesce(1).write.mode("append").text(land)
    root = fresh_path(t.spark, "stream-tickers")
    sink = ST.TickerSink(t.spark, root, t.symbols, F.lit(_STREAM_TICKER_NOW).cast("timestamp"))

    def twice(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        if epoch:
            sink(batch, epoch)

    ST.run_foreach_batch(ST.ticker_document_stream(t.spark, land, 1), "stream-tickers", twice, mode="append")
    names = sink.known().select(F.col("id").alias("symbol_id"), F.col("symbol").alias("db_symbol"))
    made = t.spark.read.parquet(f"{root}/symbols").select(F.col("symbol").alias("db_symbol"), (F.col("epoch") == 2).alias("in_third_epoch"))
    counts = names.groupBy("db_symbol").agg(F.count(F.lit(1)).cast("int").alias("rows_of_symbol"))
    return (sink.table().join(names, "symbol_id").join(made, "db_symbol").join(counts, "db_symbol")
            .select("db_symbol", "data_source", "in_third_epoch", "price", "rows_of_symbol"))
