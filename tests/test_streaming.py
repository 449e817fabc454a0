"""Streaming fault tolerance: restart from a checkpoint, idempotent epoch retries."""

import datetime as dt

from pyspark.sql import functions as F

from tickframe.session import fresh_path
from tickframe.sources.tables import ticks
from tickframe.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def _run(spark, stream, sink, ckpt):
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def test_candle_stream_resumes_from_checkpoint(spark):
    tk = ticks(spark, SF)
    cut = tk.agg(F.expr("percentile_approx(unix_seconds(ts), 0.5)")).first()[0]
    early = tk.filter(F.unix_seconds("ts") < cut)
    late = tk.filter(F.unix_seconds("ts") >= cut)
    land = fresh_path(spark, "t-land")
    ST.land_in_order(early, "ts", land, 3)
    sink, ckpt = fresh_path(spark, "t-sink"), fresh_path(spark, "t-ckpt")
    _run(spark, ST.candles_stream(ST.read_landing(spark, land, ST.TICK_SCHEMA)), sink, ckpt)
    first = spark.read.parquet(sink).count()
    ST.land_in_order(late, "ts", land, 3)          # new deliveries after the "crash"
    _run(spark, ST.candles_stream(ST.read_landing(spark, land, ST.TICK_SCHEMA)), sink, ckpt)
    resumed = spark.read.parquet(sink)

    land2 = fresh_path(spark, "t-land2")
    ST.land_in_order(tk, "ts", land2, 6)
    sink2, ckpt2 = fresh_path(spark, "t-sink2"), fresh_path(spark, "t-ckpt2")
    _run(spark, ST.candles_stream(ST.read_landing(spark, land2, ST.TICK_SCHEMA)), sink2, ckpt2)
    once = spark.read.parquet(sink2)
    assert 0 < first < resumed.count()
    assert resumed.exceptAll(once).count() == 0 and once.exceptAll(resumed).count() == 0


def test_versioned_upsert_epoch_retry_and_restart(spark):
    batch = ST.latest_prices_stream(ticks(spark, SF))
    root = fresh_path(spark, "t-ups")
    sink = ST.VersionedUpsert(spark, root, ["symbol_id", "data_source"], ["ts", "id"])
    sink(batch, 0)
    sink(batch.filter(F.col("symbol_id") < 5), 1)
    v1 = sink.table().orderBy("symbol_id", "data_source").collect()
    sink(batch.filter(F.col("symbol_id") < 5), 1)            # retry of epoch 1
    again = ST.VersionedUpsert(spark, root, ["symbol_id", "data_source"], ["ts", "id"])
    again(batch.filter(F.col("symbol_id") < 5), 1)           # restarted driver, same epoch
    v1b = again.table().orderBy("symbol_id", "data_source").collect()
    assert v1 == v1b and len(v1) == batch.count()


def test_empty_delivery_lands_and_streams(spark):
    empty = ticks(spark, SF).filter(F.col("id") < 0)
    land = ST.land_in_order(empty, "ts", fresh_path(spark, "t-empty"), 3)
    sink, _ = ST.run_to_files(ST.candles_stream(ST.read_landing(spark, land, ST.TICK_SCHEMA)), "t-empty")
    assert spark.read.schema("symbol_id int").parquet(sink).count() == 0


def test_a_failing_read_is_raised_not_taken_for_an_empty_table(spark, monkeypatch):
    import pytest

    batch = ST.latest_prices_stream(ticks(spark, SF))
    sink = ST.VersionedUpsert(spark, fresh_path(spark, "t-fail"), ["symbol_id", "data_source"], ["ts", "id"], compact_every=1)
    sink(batch, 0)

    def broken(*a, **k):
        raise OSError("storage is away")
    monkeypatch.setattr(type(spark.read), "parquet", broken)
    with pytest.raises(OSError):
        sink(batch.filter(F.col("symbol_id") < 5), 1)
    monkeypatch.undo()
    assert sink.table().count() == batch.count()


def test_late_rows_are_added_up_over_all_batches(spark):
    from types import SimpleNamespace as N

    drops = ST.WatermarkDrops(spark)
    for b in range(150):
        drops.onQueryProgress(N(progress=N(runId="r", stateOperators=[N(numRowsDroppedByWatermark=2), N(numRowsDroppedByWatermark=1)])))
    drops.onQueryTerminated(N(runId="r"))
    assert drops.total(N(runId="r")) == 450


def test_deliveries_of_several_files_give_the_same_candles(spark):
    tk = ticks(spark, SF)
    out = []
    for files in (1, 3):
        land = ST.land_in_order(tk, "ts", fresh_path(spark, "t-files"), 4, files=files)
        assert len(spark.read.parquet(land).inputFiles()) == 4 * files
        sink, _ = ST.run_to_files(ST.candles_stream(ST.read_landing(spark, land, ST.TICK_SCHEMA, files)), "t-files")
        out.append(spark.read.parquet(sink))
    assert out[0].exceptAll(out[1]).count() == 0 == out[1].exceptAll(out[0]).count() and out[0].count() > 0


def test_compacted_and_changed_epochs_read_alike(spark):
    batch = ST.latest_prices_stream(ticks(spark, SF)).cache()
    tables = []
    for every in (1, 3, 100):
        sink = ST.VersionedUpsert(spark, fresh_path(spark, "t-compact"), ["symbol_id", "data_source"], ["ts", "id"], compact_every=every)
        for epoch in range(7):
            part = batch.filter(F.pmod("symbol_id", F.lit(7)) == epoch).unionByName(
                batch.filter(F.pmod("symbol_id", F.lit(7)) == 0).withColumn("id", F.col("id") + epoch).withColumn("price", F.lit(float(epoch))))
            sink(ST.M.first_per_key(part, ["symbol_id", "data_source"], ["ts", "id"], newest=True), epoch)
        tables.append(sorted(map(tuple, sink.table().select("symbol_id", "data_source", "id", "price").collect())))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == batch.count()


def test_late_bars_are_dropped_and_counted(spark):
    import datetime as dt

    schema = "symbol_id int, time_frame string, t_stamp timestamp, close double"
    day = lambda d, c=1.0: (1, "1d", dt.datetime(2024, 1, d), c)
    land, sink, ckpt = (fresh_path(spark, f"t-ema-{x}") for x in ("land", "sink", "ckpt"))
    late = []
    for rows in ([day(1), day(2), day(3)], [day(4), day(5)], [day(2, 9.0), day(6)], [day(7)]):  # the second bar comes again, too late
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        drops = ST.WatermarkDrops(spark)
        q = (ST.ema_stream(ST.read_landing(spark, land, schema)).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        late.append(drops.total(q))
    out = spark.read.parquet(sink).orderBy("t_stamp").collect()
    assert [r.t_stamp.day for r in out][:5] == [1, 2, 3, 4, 5] and {r.ema_12 for r in out} == {1.0}
    assert late == [0, 0, 1, 0]


def test_late_rows_do_not_depend_on_files(spark):
    from tickframe.plans.q_stream import late_candles
    from tickframe.sources.catalog import MarketTables

    t = MarketTables(spark, SF)
    first = t.ticks.agg(F.min("ts")).first()[0]
    late = t.ticks.filter(F.col("ts") < F.lit(first) + F.expr("INTERVAL 1 DAY")).count()
    got = [late_candles(t, files)[:2] for files in (1, 4, 13)]
    assert got == [(t.ticks.count() + late, late)] * 3 and late > 0


def test_rolling_windows_are_two_stateful_steps(spark):
    import datetime as dt

    rows = [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), float(i), 2, "x") for i in range(200)]
    land = ST.land_in_order(spark.createDataFrame(rows, ST.TICK_SCHEMA), "ts", fresh_path(spark, "t-24h"), 3)
    sink, q = ST.run_to_files(ST.rolling_24h_stream(ST.read_landing(spark, land, ST.TICK_SCHEMA)), "t-24h")
    ops = q.lastProgress["stateOperators"] if isinstance(q.lastProgress, dict) else q.lastProgress.stateOperators
    assert len(ops) == 2
    w = {r.window_start: r for r in spark.read.parquet(sink).collect()}[dt.datetime(2024, 1, 1, 5)]
    assert (w.trades, w.volume_24h, w.first_price, w.last_price, w.change_24h) == (72, 144, 15.0, 86.0, 71.0)


def test_sink_keeps_the_first_to_arrive(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    schema = "k int, ts timestamp, v double, arrival int, slot int"
    for order in (1, -1):
        rows = [(1, t, 9.0, 1, 0), (1, t, 1.0, 2, 0), (2, t, 5.0, 1, 3), (2, t, 4.0, 1, 4), (2, t, 3.0, 2, 0)][::order]
        sink = ST.InsertIgnoreSink(spark, fresh_path(spark, "t-first"), ["k"], "ts", 60, order=["arrival", "slot"])
        for epoch in (0, 0, 1):  # a retry, and a re-send
            sink(spark.createDataFrame(rows, schema).repartition(3), epoch)
        assert sorted((r.k, r.v) for r in sink.table().collect()) == [(1, 9.0), (2, 5.0)]
        assert sink.table().columns == ["k", "ts", "v"]


def test_two_bars_of_one_time_give_one_ema(spark):
    import datetime as dt

    schema = "symbol_id int, time_frame string, t_stamp timestamp, close double"
    bar = lambda d, c: (1, "1d", dt.datetime(2024, 1, d), c)
    out = []
    for rows in ([bar(1, 5.0), bar(1, 3.0), bar(2, 4.0)], [bar(2, 4.0), bar(1, 3.0), bar(1, 5.0)]):
        land = fresh_path(spark, "t-two")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(land)
        spark.createDataFrame([bar(9, 1.0)], schema).coalesce(1).write.mode("append").parquet(land)
        sink, _ = ST.run_to_files(ST.ema_stream(ST.read_landing(spark, land, schema)), "t-two")
        out.append(sorted((r.t_stamp, r.ema_12) for r in spark.read.parquet(sink).collect()))
    assert out[0] == out[1] and out[0][0][1] == 3.0


def test_streamed_tickers_retry_gives_the_same_ids(spark):
    import datetime as dt

    from tickframe import schemas as S

    doc = lambda pair, price: f'{{"error":[],"result":{{"{pair}":{{"c":["{price}","1"]}}}}}}'
    symbols = spark.createDataFrame([(4, "AAA", "A", "NYSE", "stock", "USD", None, None, None, True, None, None)], S.SYMBOLS)
    batch = lambda n, *docs: spark.createDataFrame([(d, n) for d in docs], "value string, arrival int")
    sink = ST.TickerSink(spark, fresh_path(spark, "t-tick"), symbols, F.lit(dt.datetime(2024, 1, 1)))
    sink(batch(0, doc("AAA", 1), doc("BBB", 2), "no json", doc("CCC", "n/a"), doc("DDD", -1)), 0)
    sink(batch(1, doc("BBB", 3), doc("EEE", 4)), 1)
    once = sorted((r.symbol_id, r.price) for r in sink.table().collect())
    sink(batch(1, doc("EEE", 4), doc("BBB", 3)), 1)
    assert sorted((r.symbol_id, r.price) for r in sink.table().collect()) == once == [(4, 1.0), (5, 3.0), (6, 4.0)]
    assert {r.symbol: r.id for r in sink.known().collect()} == {"AAA": 4, "BBB": 5, "EEE": 6}


def test_ema_keeps_the_series_of_a_block_apart():
    import pandas as pd

    class Value:
        row = None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        timers = []

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, ms):
            self.timers.append(ms)

    p = ST.EmaProcessor()
    p.init(Handle())
    bars = pd.DataFrame({"symbol_id": [7, 8, 7], "t_stamp": pd.to_datetime([2000, 1000, 1000], unit="ms"), "close": [20.0, 5.0, 10.0]})
    assert list(p._run((0, "1d"), [bars], 0)) == [] and Handle.timers == [1000]   # all wait
    out = pd.concat(p._run((0, "1d"), [], 1000))
    assert sorted(zip(out.symbol_id, out.ema_12)) == [(7, 10.0), (8, 5.0)]
    out = pd.concat(p._run((0, "1d"), [bars], 2000))                               # sent again: known times are dropped
    assert out.symbol_id.tolist() == [7] and abs(out.ema_12[0] - (10.0 + 2 / 13 * 10.0)) < 1e-12


def test_a_series_without_symbol_leaves_the_others_whole(spark):
    rows = [(i, "1d", dt.datetime(2024, 1, d), float(d + (i or 0))) for i in (None, 1, 2, 100, 200) for d in range(1, 8)]
    schema = "symbol_id int, time_frame string, t_stamp timestamp, close double"
    land = ST.land_in_order(spark.createDataFrame(rows, schema), "t_stamp", fresh_path(spark, "t-null"), 3)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sink, _ = ST.run_to_files(ST.ema_stream(ST.read_landing(spark, land, schema)), "t-null")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = spark.read.parquet(sink).collect()
    assert sorted((r.symbol_id or -1, r.t_stamp.day) for r in got) == sorted((i or -1, d) for i, _, t, _ in rows for d in [t.day])
    firsts = {r.symbol_id: r.ema_12 for r in got if r.t_stamp.day == 1}
    assert firsts == {i: float(1 + (i or 0)) for i in (None, 1, 2, 100, 200)}
