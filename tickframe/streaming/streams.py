"""Structured Streaming jobs that keep the market tables current.

Sources are landing folders of Parquet files (one per delivery). Every query has its
checkpoint under the shared ``spark.checkpoint.dir``, so a restarted driver or lost executor
resumes from the last committed micro-batch. Sinks are idempotent per epoch: file sinks are
transactional, and ``foreachBatch`` writers publish each epoch to its own version path
(a retried epoch rewrites the same path).
"""

from __future__ import annotations

import sys
import threading

from collections import defaultdict
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import merge as M
from ..session import PARQUET, fresh_path, scratch

# The grouped-map / stateful functions below run in Python workers; ship this module's code
# with the task (pickle by value) so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TICK_SCHEMA = "id bigint, symbol_id int, ts timestamp, price double, size bigint, data_source string"


# --------------------------------------------------------------------------- landing / running
def land_in_order(df: DataFrame, ts_col: str, path: str, chunks: int, fmt: str = "parquet", files: int = 1) -> str:
    """Producer for tests and backfills: deliver ``df`` as ``chunks`` deliveries in event-time order.

    The time range is cut into equal spans and each span is written by its own job as ``files``
    files (tasks), so arrival order follows event time as in a live feed. A stream that reads
    ``files`` files per trigger takes one delivery at a time, each file in its own task.
    """
    for _ in deliveries(df, ts_col, path, chunks, fmt, files):
        pass
    return path


def deliveries(df: DataFrame, ts_col: str, path: str, chunks: int, fmt: str = "parquet", files: int = 1) -> Iterator[int]:
    """The deliveries of ``land_in_order`` one at a time: each is landed when the next one is asked for, so a consumer
    can work one off (and delete it) before the next arrives."""
    with scratch(df.sparkSession) as here:
        # computed once, re-read per chunk
        src = M.staged(df.select(ts_col, "value") if fmt == "text" else df, "deliveries", path=f"{here}/deliveries")
        lo, hi = src.agg(F.min(ts_col), F.max(ts_col)).first()
        if lo is None:  # nothing to deliver: land one empty file so the folder and schema exist
            empty = src.limit(0)
            (empty.select("value").write.mode("append").text(path) if fmt == "text"
             else empty.write.mode("append").parquet(path))
            yield 0
            return
        span = (hi - lo) / chunks
        for i in range(chunks):
            a = lo + span * i
            cond = F.col(ts_col) >= F.lit(a)
            if i < chunks - 1:
                cond = cond & (F.col(ts_col) < F.lit(lo + span * (i + 1)))
            part = src.filter(cond)
            if fmt == "text":
                part.select("value").repartition(files).write.mode("append").text(path)
            else:
                part.repartition(files).write.options(**PARQUET).mode("append").parquet(path)
            yield i


def read_landing(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet. Any other failure to
    read is raised: taking it for an empty table would drop what is stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _rocksdb(spark: SparkSession) -> None:
    """Keep state off the JVM heap also on a session that the library did not build, and its changes small on disk
    (a checkpoint remembers the codec that it was begun with)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    key = "spark.sql.streaming.stateStore.compression.codec"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "zstd")


def run_to_files(stream: DataFrame, name: str, mode: str = "append", keep: bool = False) -> tuple:
    """Run a stream over everything available now into a Parquet sink; return (path, query), with
    ``keep`` also the checkpoint's path."""
    spark = stream.sparkSession
    _rocksdb(spark)
    sink, ckpt = fresh_path(spark, f"{name}-out"), fresh_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").options(**PARQUET).option("path", sink).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return (sink, q, ckpt) if keep else (sink, q)


def run_foreach_batch(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None],
                      mode: str = "update", checkpoint: str | None = None) -> object:
    """Run a stream over everything available now; with ``checkpoint`` it goes on from there."""
    spark = stream.sparkSession
    _rocksdb(spark)
    ckpt = checkpoint or fresh_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# --------------------------------------------------------------------------- T1 latest prices
class VersionedUpsert:
    """foreachBatch sink: an upserted table kept as one folder per epoch. An epoch stores the keys
    that it changed; every ``compact_every``-th epoch stores the whole table, so a read merges a
    bounded number of epochs. The table is found in storage, not in driver memory, and an epoch
    writes nothing but its own folder: a retried epoch or a restarted driver rebuilds the same."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: list[str], compact_every: int = 20):
        self.spark, self.root, self.key, self.order, self.compact_every = spark, root, key, order, compact_every

    def table(self, before: int | None = None) -> DataFrame | None:
        """The newest row per key (of the epochs before ``before``); None where nothing is stored."""
        rows = existing(self.spark, self.root)
        if rows is None:
            return None
        if before is not None:
            rows = rows.filter(F.col("epoch") < before)
        whole = rows.filter("kind = 'whole'").agg(F.max("epoch")).first()[0]
        if whole is not None:
            rows = rows.filter(F.col("epoch") >= whole)
        return M.first_per_key(rows.drop("epoch", "kind"), self.key, self.order, newest=True)

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        compact = epoch_id % self.compact_every == 0
        prev = self.table(before=epoch_id) if compact else None
        rows = batch if prev is None else M.first_per_key(prev.unionByName(batch), self.key, self.order, newest=True)
        rows.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch_id}/kind={'whole' if compact else 'changed'}")


def latest_prices_stream(ticks: DataFrame) -> DataFrame:
    """Newest tick per (symbol, source) as a streaming aggregate (state = one row per key)."""
    order = F.struct("ts", "id")
    return ticks.groupBy("symbol_id", "data_source").agg(
        F.max_by("id", order).alias("id"), F.max("ts").alias("ts"),
        F.max_by("price", order).alias("price"), F.max_by("size", order).alias("size"))


# --------------------------------------------------------------------------- T2 / T4 / T5 windows
def candles_stream(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV windows; a window is emitted once the watermark passes its end."""
    order = F.struct("ts", "id")
    return (ticks.withWatermark("ts", delay)
            .groupBy("symbol_id", "data_source", F.window("ts", width).alias("w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
            .select("symbol_id", "data_source", F.col("w.start").alias("t_stamp"),
                    "open", "high", "low", "close", "volume", "trades"))


def rolling_24h_stream(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """T5: 24 h windows sliding every hour: volume, first/last price, change.

    Two stateful steps in one query: hourly totals (one row per symbol and hour leaves the first), then
    24 h windows over these rows' ``window_time``. A tick belongs to one hour and is shuffled once.
    """
    tick = F.struct("ts", "id", "price")
    hourly = (ticks.withWatermark("ts", delay).groupBy("symbol_id", F.window("ts", "1 hour").alias("h"))
              .agg(F.sum("size").alias("size"), F.min(tick).alias("first"), F.max(tick).alias("last"), F.count(F.lit(1)).alias("n"))
              .select("symbol_id", F.window_time("h").alias("t"), "size", "first", "last", "n"))
    g = (hourly.groupBy("symbol_id", F.window("t", "24 hours", "1 hour").alias("w"))
         .agg(F.sum("size").alias("volume_24h"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("trades")))
    return g.select("symbol_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "volume_24h", F.col("first.price").alias("first_price"), F.col("last.price").alias("last_price"),
                    (F.col("last.price") - F.col("first.price")).alias("change_24h"), "trades")


#: Name of the observed metric that counts a stream's input rows.
READ = "rows_read"


def counted(stream: DataFrame) -> DataFrame:
    """The stream with its rows counted as they are read, before any aggregation."""
    return stream.observe(READ, F.count(F.lit(1)).alias("rows"))


def late_rows(spark: SparkSession, read: int, closed: DataFrame, checkpoint: str) -> int:
    """T4: how many of the ``read`` rows of a ``candles_stream`` came too late: those that are neither in
    a closed window (``closed``, with ``trades``) nor in one that is still open in the state store.

    Spark's own metric counts what reaches the stateful operator, which is one partial group per
    input partition and window; this is the number of rows, however they lay in files and tasks.
    """
    inside = closed.agg(F.coalesce(F.sum("trades"), F.lit(0))).first()[0]
    state = spark.read.format("statestore").load(checkpoint)
    still = state.agg(F.coalesce(F.sum(F.col("value.count")), F.lit(0))).first()[0]
    return read - inside - still


class WatermarkDrops(StreamingQueryListener):
    """What progress events tell, added up over every micro-batch of each query (a query's own progress
    list keeps only the last hundred): groups dropped as too late, and rows read."""

    def __init__(self, spark: SparkSession):
        self.dropped: dict[str, int] = {}
        self.observed: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)
        self.spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.runId)] = self.dropped.get(str(p.runId), 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        rows = (getattr(p, "observedMetrics", None) or {}).get(READ)
        if rows is not None:
            self.observed[str(p.runId)] = self.observed.get(str(p.runId), 0) + rows["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def total(self, query, timeout: float = 60.0) -> int:
        """The count of an ended query, once all its events have arrived."""
        if not self.ended[str(query.runId)].wait(timeout):
            raise TimeoutError("the query's last event has not arrived")
        self.spark.streams.removeListener(self)
        return self.dropped.get(str(query.runId), 0)

    def rows(self, query, timeout: float = 60.0) -> int:
        """The rows that an ended query with ``counted`` input has read."""
        self.total(query, timeout)
        return self.observed.get(str(query.runId), 0)


# --------------------------------------------------------------------------- T3 dedup
def dedup_stream(ticks: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop re-deliveries of the same key arriving within the watermark delay."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


class InsertIgnoreSink:
    """foreachBatch: append only keys not yet in the table (U1), checking the table only in
    the batch's event-time range widened by the watermark delay (re-deliveries older than
    that were already dropped by the stream as late). Each epoch is partitioned by month, so the
    check opens only the months in that range. Of several rows of one key in a batch the first by
    ``order`` (columns that tell the arrival) and then by the values is kept: a retried epoch keeps the same."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], ts_col: str, delay_seconds: int, order: list[str] | None = None):
        self.spark, self.root, self.key, self.ts_col, self.delay, self.order = spark, root, key, ts_col, delay_seconds, order

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.root).drop("epoch", "_month")

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        path = f"{self.root}/epoch={epoch_id}"
        # two actions read the batch (its time bounds, then the write): compute it once
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            order = [*(self.order or []), *(c for c in batch.columns if c not in self.key and c not in (self.order or []))]
            fresh = M.first_per_key(batch, self.key, order).drop(*(c for c in ("arrival", "slot") if c in order))
            table = existing(self.spark, self.root)
            if table is not None:
                b = batch.agg(F.min(self.ts_col).alias("lo"), F.max(self.ts_col).alias("hi")).first()
                if b["lo"] is not None:
                    near = table.filter((F.col(self.ts_col) >= F.lit(b["lo"]) - F.expr(f"INTERVAL {self.delay} SECONDS"))
                                        & (F.col(self.ts_col) <= F.lit(b["hi"])))
                    near = near.filter((F.col("epoch") != epoch_id) & F.col("_month").between(
                        int((b["lo"] - timedelta(seconds=self.delay)).strftime("%Y%m")), int(b["hi"].strftime("%Y%m"))))
                    fresh = fresh.join(near.select(*self.key), self.key, "left_anti")
            (fresh.withColumn("_month", F.date_format(self.ts_col, "yyyyMM").cast("int"))
             .write.options(**PARQUET).mode("overwrite").partitionBy("_month").parquet(path))
        finally:
            batch.unpersist()


def documents_with_arrival(spark: SparkSession, landing: str, files_per_batch: int = 1) -> DataFrame:
    """Landed text documents with ``arrival``: the file's time and name and the block in it (lines of one
    block have no order that a stream knows; whoever needs one goes on by the values)."""
    from ..sources.payloads import stream_landing

    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return stream_landing(spark, landing, files_per_batch).select("value", arrival.alias("arrival"))


OHLC_KEY = ["pair", "t_stamp", "time_frame", "data_source"]


def ohlc_document_stream(spark: SparkSession, landing: str, time_frame: str, files_per_batch: int = 1) -> DataFrame:
    """Landed OHLC documents (text, one per line) -> decoded candles with their arrival (file time, name
    and block; slot in the document)."""
    from ..functions import payload as PL

    raw = documents_with_arrival(spark, landing, files_per_batch)
    ok, _ = PL.split_errors(raw)
    return PL.decode_ohlc(PL.ohlc_records(ok), time_frame).drop("value", "last")


# --------------------------------------------------------------------------- S10 / S13 streamed tickers
class TickerSink:
    """foreachBatch: ticker documents -> latest prices, with symbols created as they first appear.

    Each epoch parses its documents once, joins them with the symbols known before the epoch (the given
    ones and those that earlier epochs created), writes the new symbols and then the changed prices,
    each to the epoch's own folder. A retried epoch sees only earlier epochs' symbols, gives the
    same ids and overwrites the same folders.
    """

    def __init__(self, spark: SparkSession, root: str, symbols: DataFrame, now: Column):
        self.spark, self.root, self.symbols, self.now = spark, root, symbols, now
        self.prices = VersionedUpsert(spark, f"{root}/prices", M.PRICE_KEY, ["arrival"])
        self.rejected = 0

    def known(self, before: int | None = None) -> DataFrame:
        """The symbols table (of the epochs before ``before``)."""
        made = existing(self.spark, f"{self.root}/symbols")
        if made is None:
            return self.symbols
        if before is not None:
            made = made.filter(F.col("epoch") < before)
        return self.symbols.unionByName(made.select(*self.symbols.columns))

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        from ..functions import payload as PL
        from ..functions.pairs import pair_to_symbol
        from ..operators.reads import validate_prices

        docs = PL.landed_documents(batch)
        valid, _ = validate_prices(PL.decode_ticker(docs).withColumn("db_symbol", pair_to_symbol(F.col("pair"))))
        known = self.known(before=epoch_id)
        path = f"{self.root}/symbols/epoch={epoch_id}"
        M.new_symbols(valid.select(F.col("db_symbol").alias("symbol")), known, self.now).write.mode("overwrite").parquet(path)
        every = known.unionByName(self.spark.read.schema(known.schema).parquet(path))
        rows = valid.join(every.select(F.col("symbol").alias("db_symbol"), F.col("id").alias("symbol_id")), "db_symbol").select(
            *M.PRICE_KEY, *[c for c in M.PRICE_FIELDS if c != "market_cap"], "arrival")
        newest = M.first_per_key(rows, M.PRICE_KEY, ["arrival", *[c for c in M.PRICE_FIELDS if c != "market_cap"]], newest=True)
        self.prices(newest, epoch_id)

    def table(self) -> DataFrame | None:
        return self.prices.table()


def ticker_document_stream(spark: SparkSession, landing: str, files_per_batch: int = 1) -> DataFrame:
    """Landed ticker documents with their arrival."""
    return documents_with_arrival(spark, landing, files_per_batch)


# --------------------------------------------------------------------------- T6 incremental EMA / RSI
#: Symbols of neighbouring ids whose series of one time frame share a state row and a call into Python, each of
#: which costs far more than the bars of one series in a batch.
EMA_BLOCK = 64
EMA_RUNNING = "n long, last_ms long, e12 double, e26 double, prev double, gs double, ls double, ag double, al double"
EMA_FIELDS = [f.split()[0] for f in EMA_RUNNING.split(", ")]
EMA_STATE = ("symbol_id array<int>, " + ", ".join("{} array<{}>".format(*f.split()) for f in EMA_RUNNING.split(", "))
             + ", pend_id array<int>, pend_ms array<long>, pend_close array<double>")
EMA_OUT = "symbol_id int, time_frame string, t_stamp timestamp, ema_12 double, ema_26 double, rsi_14 double"


def _ema_step(st: dict, close: float) -> tuple[float, float, float | None]:
    """One bar of EMA12/EMA26 (seeded with the first close) and Wilder RSI14."""
    a12, a26 = 2.0 / 13, 2.0 / 27
    st["n"] += 1
    n = st["n"]
    if n == 1:
        st["e12"] = st["e26"] = close
    else:
        st["e12"] = a12 * close + (1.0 - a12) * st["e12"]
        st["e26"] = a26 * close + (1.0 - a26) * st["e26"]
        d = close - st["prev"]
        g = d if d > 0 else 0.0
        lo = -d if d < 0 else 0.0
        if n < 15:
            st["gs"] += g
            st["ls"] += lo
        elif n == 15:
            st["gs"] += g
            st["ls"] += lo
            st["ag"], st["al"] = st["gs"] / 14, st["ls"] / 14
        else:
            st["ag"] = (st["ag"] * 13 + g) / 14
            st["al"] = (st["al"] * 13 + lo) / 14
    st["prev"] = close
    rsi = None
    if st["ag"] is not None:
        rsi = 100.0 if st["al"] == 0 else 100.0 - 100.0 / (1.0 + st["ag"] / st["al"])
    return st["e12"], st["e26"], rsi


class EmaProcessor(StatefulProcessor):
    """Per block of series: bars wait until the watermark passes them and are then released, each series in
    time order. A block's running values and waiting bars (those of one watermark delay) are one state row,
    read and written once per block and batch. Bars at or below the watermark never reach it: Spark drops
    them and counts them (``WatermarkDrops``)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getValueState("values", EMA_STATE)

    def close(self) -> None:
        pass

    def _state(self) -> tuple[dict, dict]:
        """Running values, and waiting bars (time -> close), of each series of the block."""
        running: dict[int | None, dict] = {}
        waiting: dict[int | None, dict[int, float]] = defaultdict(dict)
        got = self.values.get()
        if got is not None:
            ids, *values = got[:1 + len(EMA_FIELDS)]
            running = {i: dict(zip(EMA_FIELDS, v)) for i, *v in zip(ids, *values)}
            for i, m, c in zip(*got[1 + len(EMA_FIELDS):]):
                waiting[i][m] = c
        return running, waiting

    def _run(self, key, pdfs, watermark: int):
        running, waiting = self._state()
        arrived: dict[int | None, dict[int, float]] = defaultdict(dict)
        for pdf in pdfs:
            ids = [None if pd.isna(i) else int(i) for i in pdf["symbol_id"].tolist()]  # floats where a batch holds a NULL
            for i, m, c in zip(ids, pdf["t_stamp"].astype("datetime64[ms]").astype("int64").tolist(), pdf["close"].tolist()):
                if (i not in running or m > running[i]["last_ms"]) and m not in waiting[i]:
                    arrived[i][m] = min(c, arrived[i].get(m, c))  # two bars of one time in a batch have no order: the lower close
        for i, bars in arrived.items():
            waiting[i].update(bars)
        rows = []
        for i, bars in waiting.items():
            for m in sorted(m for m in bars if m <= watermark):
                st = running.setdefault(i, dict(n=0, last_ms=None, e12=None, e26=None, prev=None, gs=0.0, ls=0.0, ag=None, al=None))
                rows.append((i, key[1], m, *_ema_step(st, bars.pop(m))))
                st["last_ms"] = m
        pend = sorted((m, i, c) for i, bars in waiting.items() for m, c in bars.items())
        self.values.update((list(running), *([st[f] for st in running.values()] for f in EMA_FIELDS),
                            [i for _, i, _ in pend], [m for m, _, _ in pend], [c for _, _, c in pend]))
        if pend:
            self.handle.registerTimer(max(pend[0][0], watermark + 1))
        if rows:
            out = pd.DataFrame(rows, columns=["symbol_id", "time_frame", "t_stamp", "ema_12", "ema_26", "rsi_14"])
            yield out.astype({"t_stamp": "datetime64[ms]", "ema_12": "float64", "ema_26": "float64", "rsi_14": "float64"})

    def handleInputRows(self, key, rows, timerValues):
        yield from self._run(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._run(key, (), timerValues.getCurrentWatermarkInMs())


def ema_stream(bars: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Incremental EMA/RSI per series with state (transformWithStateInPandas, event-time timers)."""
    _rocksdb(bars.sparkSession)
    # no block is NULL: pandas would make the keys of its whole batch floats, which find no state
    block = F.coalesce(F.floor(F.col("symbol_id") / EMA_BLOCK), F.lit(-2 ** 31).cast("bigint"))
    return (bars.withWatermark("t_stamp", delay).withColumn("_block", block).groupBy("_block", "time_frame")
            .transformWithStateInPandas(EmaProcessor(), EMA_OUT, "Append", "EventTime"))
