"""What jobs leave on disk and shuffle: staged tables go when their job has written its results, shuffles carry each
value once."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tickframe.functions import payload as PL
from tickframe.operators import merge as M
from tickframe.operators import quality as Q
from tickframe.session import checkpoint_root, ensure_conf, fresh_path, scratch, staged
from tickframe.sources import payloads as SP
from tickframe.sources import tables as TB
from tickframe.sources.catalog import MarketTables
from tickframe.streaming import streams as ST

SF = E.SMOKE_DIR


def folders(spark) -> set[str]:
    """Names (without their ids) of what lies in the shared folder, scratches and their contents included."""
    root = checkpoint_root(spark).removeprefix("file:")
    return {os.path.join(d, x) for d, names, _ in os.walk(root) for x in names}


def left_by(spark, run) -> set[str]:
    before = folders(spark)
    run()
    return {"-".join(os.path.basename(x).split("-")[:-1]) for x in folders(spark) - before}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ohlc_ingest", "ohlc_ingest_metrics", "ohlc_first_arrival"])
def test_ingests_leave_no_intermediates(spark, name):
    left = left_by(spark, lambda: E.queries()[name](spark, SF).collect())
    assert "market_data" in left
    assert not left & {"ohlc-landed", "ohlc-conflicts", "documents", "ohlc-batch", "ohlc-fresh", "bars", "scratch"}


def test_quarantine_outlives_the_batch(spark):
    rows = [("S1-A", 1, -1.0), ("S1-A", 2, 1.0), ("S2-A", 1, 2.0)]
    decoded = spark.createDataFrame(rows, "pair string, d int, open double").select(
        "pair", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("t_stamp"), "open", F.lit(3.0).alias("high"),
        F.lit(0.5).alias("low"), F.lit(1.0).alias("close"), F.lit(5).cast("bigint").alias("volume"), F.lit(1.0).alias("adjusted_close"),
        F.lit("1d").alias("time_frame"), F.lit("kraken").alias("data_source"))
    symbols = TB.symbols(spark, SF)
    path = fresh_path(spark, "market_data")
    with scratch(spark):
        syms, bad, counts = M.ingest_ohlc(decoded, symbols, path, F.lit("2024-02-01").cast("timestamp"))
    assert [(r.pair, r.open) for r in bad.collect()] == [("S1-A", -1.0)]
    assert {r.metric: r.value for r in counts.collect()} == {"fetched": 3, "inserted": 2, "quarantined": 1}
    assert M.read_candles(spark, path).join(syms, F.col("symbol_id") == syms.id).count() == 2


def test_indicator_table_leaves_no_bars(spark):
    t = MarketTables(spark, SF)
    left = left_by(spark, lambda: t.indicators.count())
    assert left & {"technical_indicators", "bars", "scratch"} == {"technical_indicators"}


def test_dq_on_write_keeps_one_copy_of_the_indicators(spark):
    left = left_by(spark, lambda: E.queries()["dq_on_write"](spark, SF).collect())
    assert "checked-technical_indicators" in left
    assert not left & {"technical_indicators", "bars", "repeated-keys", "scratch"}


def test_scratch_goes_also_after_a_failure(spark):
    with pytest.raises(ValueError), scratch(spark) as here:
        staged(spark.range(3), "x")
        kept = staged(spark.range(3), "kept", keep=True)
        assert os.path.isdir(here.removeprefix("file:"))
        raise ValueError
    assert not os.path.exists(here.removeprefix("file:"))
    assert kept.count() == 3


def test_shuffle_files_go_with_their_query(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_conf(spark)
    assert spark.conf.get(key) == "true"
    spark.conf.set(key, "false")
    try:
        assert ensure_conf(spark).conf.get(key) == "false"  # a session's own choice stays
    finally:
        spark.conf.set(key, "true")


def test_documents_shuffle_numbers_not_text(spark):
    t = MarketTables(spark, SF)
    docs = SP.ohlc_payloads(t.candles, F.concat(F.lit("S"), F.col("symbol_id"), F.lit("-"), "data_source"))
    below = plan(docs).split("Exchange")[1:]
    assert below and not any("concat_ws(\",\"" in x for x in below)


def test_documents_of_equal_times_are_ordered_by_text(spark):
    rows = [(2.0, 10), (10.0, 10), (None, None)]
    bars = spark.createDataFrame(rows, "open double, volume bigint").select(
        F.lit("f").alias("data_source"), F.lit("2024-01-01").cast("timestamp").alias("t_stamp"), "open", F.lit(3.0).alias("high"),
        F.lit(1.0).alias("low"), F.lit(1.5).alias("close"), "volume")
    (doc,) = SP.ohlc_payloads(bars, F.lit("P")).collect()
    at, rest = '[1704067200,"', '","3.0","1.0","1.5","1.5","'
    recs = ",".join([f'{at}10.0{rest}10.0",1]', f'{at}2.0{rest}10.0",1]', f'{at}null{rest}null",1]'])
    assert doc.value == '{"error":[],"result":{"P":[' + recs + '],"last":1704067200}}'


def test_first_and_last_line_carry_their_price(spark):
    text = plan(TB.market_data(spark, SF))
    assert "min_by" not in text and "max_by" not in text


def test_stored_symbols_are_broadcast(spark):
    t = MarketTables(spark, SF)
    text = plan(t.candles.join(t.stored_symbols.select(F.col("id").alias("symbol_id"), "symbol"), "symbol_id"))
    assert "BroadcastHashJoin" in text



def keyed(spark, rows):
    return spark.createDataFrame([(s, t, f, v) for s, t, f, v in rows], "symbol_id int, t string, time_frame string, rsi_14 double").select(
        "symbol_id", F.col("t").cast("timestamp").alias("timestamp"), "time_frame", "rsi_14")


@pytest.mark.parametrize("unique", [0, 9])
def test_once_per_key(spark, unique):
    """Repeated keys, some with NULLs, among few or many rows with keys of their own."""
    rows = [(1, "2024-01-01", "1d", 2.0), (1, "2024-01-01", "1d", 1.0), (2, None, "1d", 5.0), (2, None, "1d", 4.0), (None, None, None, 1.0)]
    rows += [(10 + i, "2024-01-01", "1d", float(i)) for i in range(unique)]
    stored, out = [], {}
    df = staged(keyed(spark, rows), "keyed")

    def write(name, rows):
        rows = staged(rows, "written", keep=True)
        stored.extend(tuple(r) for r in rows.select("symbol_id", "rsi_14").collect())

    out = {r.rule: r.violations for r in Q.write_checked(spark, {"technical_indicators": df}, write).collect()}
    assert sorted(stored, key=str) == sorted([(1, 1.0), (2, 4.0), (None, 1.0)] + [(10 + i, float(i)) for i in range(unique)], key=str)
    assert out["duplicate_keys_dropped"] == 2
    assert (out["symbol_id_missing"], out["timestamp_missing"], out["time_frame_missing"]) == (1, 3, 1)


def test_rows_of_their_own_key_are_not_shuffled(spark):
    df = staged(keyed(spark, [(i, "2024-01-01", "1d", 1.0) for i in range(20)] + [(0, "2024-01-01", "1d", 2.0)]), "keyed")
    with scratch(spark):
        parts, _ = Q.once_per_key(df, ["symbol_id", "timestamp", "time_frame"], "technical_indicators")
        assert len(parts) == 2 and "hashpartitioning" not in plan(parts[0][0])
        assert sorted(p.count() for p, _ in parts) == [1, 19]


def test_an_empty_table_is_written(spark):
    df = staged(keyed(spark, []), "keyed")
    written = []
    out = {r.rule: r.violations for r in Q.write_checked(spark, {"technical_indicators": df}, lambda _, rows: written.append(staged(rows, "w", keep=True))).collect()}
    assert written[0].count() == 0 and set(out.values()) == {0}


def test_deliveries_arrive_one_at_a_time(spark):
    rows = spark.range(10).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("string").alias("value"))
    land = fresh_path(spark, "landing")
    seen = []
    for _ in ST.deliveries(rows, "ts", land, 3, fmt="text"):
        seen.append(spark.read.text(land).count())
    assert seen[0] < seen[1] < seen[2] == 10


def test_streamed_documents_leave_no_landing(spark):
    got = []
    left = left_by(spark, lambda: got.extend(E.queries()["stream_ohlc_ingest"](spark, SF).select("pair", "t_stamp").collect()))
    assert not any(x in left for x in ("landing-ohlc", "deliveries", "scratch"))
    assert len(got) == len(set(got)) == MarketTables(spark, SF).candles.count()


def test_state_changes_are_compressed(spark):
    ST._rocksdb(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.compression.codec") == "zstd"


def test_documents_are_stored_without_their_text(spark):
    raw = spark.createDataFrame([('{"error":[],"result":{"P":[[1,"1","1","1","1","1","1",1]],"last":1}}',)], "value string")
    docs = PL.landed_documents(raw, keep_text=False)
    assert docs.columns == ["doc"] and PL.decode_ohlc(PL.ohlc_records(docs), "1d").count() == 1
