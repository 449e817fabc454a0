"""Indicators and candle invariants against brute force on small inputs."""

import datetime as dt
import math

import pytest

from pyspark.sql import functions as F

from tickframe.operators import indicators as I
from tickframe.operators import stats as A


def _bars(spark, closes, highs=None, lows=None, vols=None):
    n = len(closes)
    highs = highs or [c + 1.0 for c in closes]
    lows = lows or [c - 1.0 for c in closes]
    vols = vols or [100 + i for i in range(n)]
    rows = [(7, "1d", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "s", closes[i], highs[i], lows[i], closes[i], vols[i])
            for i in range(n)]
    df = spark.createDataFrame(rows, "symbol_id int, time_frame string, t_stamp timestamp, data_source string, "
                                     "open double, high double, low double, close double, volume bigint")
    return I.series_bars(df)


def _col(df, c):
    return [r[c] for r in df.orderBy("t_stamp").collect()]


def test_sma_and_warmup(spark):
    closes = [float(i) for i in range(1, 31)]
    out = I.window_indicators(_bars(spark, closes))
    sma5 = _col(out, "sma_5")
    assert sma5[:4] == [None] * 4
    assert sma5[4:] == [sum(closes[i - 4:i + 1]) / 5 for i in range(4, 30)]
    assert _col(out, "sma_50") == [None] * 30


def test_ema_rsi_brute_force(spark):
    closes = [10, 11, 10.5, 12, 13, 12.5, 12, 14, 15, 14.5, 16, 15, 17, 18, 17.5, 19, 18, 20, 21, 19.5]
    closes = [float(c) for c in closes]
    out = I.recurrence_indicators(_bars(spark, closes))
    e = closes[0]
    exp = [e]
    for c in closes[1:]:
        e = (2 / 13) * c + (1 - 2 / 13) * e
        exp.append(e)
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(_col(out, "ema_12"), exp))
    rsi = _col(out, "rsi_14")
    assert rsi[:14] == [None] * 14
    d = [closes[i] - closes[i - 1] for i in range(1, 15)]
    ag = sum(x for x in d if x > 0) / 14
    al = sum(-x for x in d if x < 0) / 14
    assert math.isclose(rsi[14], 100 - 100 / (1 + ag / al), rel_tol=1e-12)


def test_rsi_monotonic_is_100_and_stoch_range(spark):
    closes = [float(i) for i in range(1, 41)]
    out = I.all_indicators(_bars(spark, closes))
    assert all(v == 100.0 for v in _col(out, "rsi_14")[14:])
    k = [v for v in _col(out, "stoch_k") if v is not None]
    assert all(0 <= v <= 100 for v in k)
    assert _col(out, "obv")[0] == 0.0 and _col(out, "obv")[1] == 101.0


def test_atr_adx_warmup_positions(spark):
    closes = [100 + math.sin(i / 3) * 5 for i in range(60)]
    out = I.recurrence_indicators(_bars(spark, closes))
    atr, adx = _col(out, "atr_14"), _col(out, "adx")
    assert atr[:13] == [None] * 13 and atr[13] is not None
    assert adx[:27] == [None] * 27 and adx[27] is not None
    assert all(0 <= v <= 100 for v in adx[27:])


def test_candle_invariants_from_ticks_and_rollup(spark):
    from tickframe.sources.catalog import MarketTables

    t = MarketTables(spark, "/root/testdata/sf0.001")
    for df in [A.candles_from_ticks(t.ticks, "1h"), A.candles_rollup(t.candles, "1w"), A.candles_rollup(t.candles, "1M")]:
        bad = df.filter(~((F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))))
        assert bad.count() == 0
    assert A.candles_rollup(t.candles, "1w").filter(F.dayofweek("t_stamp") != 2).count() == 0


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, "a", 1, 10.0), (1, "a", 3, 30.0), (1, "a", 2, 20.0), (2, "a", 1, 5.0)],
                               "symbol_id int, data_source string, id bigint, price double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.symbol_id: r.price for r in I.latest_per_key(df, ["symbol_id", "data_source"]).collect()}
    assert got == {1: 30.0, 2: 5.0}


def test_indicator_table_storage_types_and_key(spark):
    from tickframe.operators import merge as M
    from tickframe.session import fresh_path
    from tickframe.sources.tables import market_data

    ind = I.technical_indicators(market_data(spark, "/root/testdata/sf0.001"))
    stored = M.to_storage(ind, "technical_indicators")
    path = M.publish(stored, fresh_path(spark, "ti"))
    back = spark.read.parquet(path)
    types = dict(back.dtypes)
    assert types["sma_20"] == "decimal(20,8)" and types["rsi_14"] == "decimal(10,4)"
    assert types["volume_sma_20"] == "bigint" and types["adx"] == "decimal(10,4)"
    n = back.count()
    assert n == back.select("symbol_id", "timestamp", "time_frame").distinct().count() > 0
    assert back.filter(F.col("id").isNull()).count() == 0 and back.select("id").distinct().count() == n


def test_unlisted_time_frames_are_series_of_their_own(spark):
    import datetime as dt

    from tickframe import schemas as S
    from tickframe.operators import indicators as I

    rows = [(i, 1, dt.datetime(2024, 1, 1 + i % 10), 1.0, 2.0, 0.5, float(10 + f), 1, None, tf, "x", None)
            for f, tf in enumerate(["2h", "3h", None, "1d"]) for i in range(10)]
    out = I.technical_indicators(spark.createDataFrame(rows, S.MARKET_DATA.fromJson({**S.MARKET_DATA.jsonValue(), "fields": [
        {**x, "nullable": True} for x in S.MARKET_DATA.jsonValue()["fields"]]})).withColumn("id", F_id())).collect()
    sma = {r.time_frame: {x.sma_5 for x in out if x.time_frame == r.time_frame and x.sma_5 is not None} for r in out}
    assert sma == {"2h": {10.0}, "3h": {11.0}, None: {12.0}, "1d": {13.0}}
    assert len({r.id for r in out}) == len(out) == 40


def F_id():
    from pyspark.sql import functions as F

    return F.col("id").cast("bigint")


def _wave(spark, series, n):
    rows = [(sid, "1d", dt.datetime(2020, 1, 1) + dt.timedelta(days=i + i // 40 * 3), "s", c, c + 1 + i % 3, c - 1 - i % 5, c, 100 + i * sid % 17)
            for sid in series for i in range(n + sid) for c in [100 + 7 * math.sin(i / (3 + sid)) + (i * i * sid) % 11]]
    df = spark.createDataFrame(rows, "symbol_id int, time_frame string, t_stamp timestamp, data_source string, "
                                     "open double, high double, low double, close double, volume bigint").repartition(5)
    return I.series_bars(df)


def test_fifty_chunks_equal_one(spark):
    bars = _wave(spark, [1, 2], 500)
    key = lambda r: (r.symbol_id, r.t_stamp)
    whole = sorted(I.all_indicators(bars).collect(), key=key)
    assert len(whole) == 1003
    for chunk_bars in (10, 64, 300):
        parts = sorted(I.all_indicators(bars, chunk_bars=chunk_bars).collect(), key=key)
        assert len(parts) == len(whole)
        for a, b in zip(whole, parts):
            for c in I.WINDOW_COLUMNS + I.RECURRENCE_COLUMNS + ["t_stamp", "close"]:
                x, y = a[c], b[c]
                assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (chunk_bars, key(a), c, x, y)
    some = sorted(I.recurrence_indicators(bars, ["adx", "macd_signal"], chunk_bars=10).collect(), key=key)
    assert all(math.isclose(a.adx, b.adx, abs_tol=1e-9) for a, b in zip(whole, some) if a.adx is not None)
    assert [r.adx is None for r in some] == [r.adx is None for r in whole]


def test_chunks_of_a_hot_series_lie_in_many_tasks(spark):
    b = I.numbered(_wave(spark, [1], 800), chunk_bars=100)
    own = b.own(b.rows)
    assert sorted(r.rn for r in own.select("rn").collect()) == list(range(1, 802))
    assert {r[0] for r in own.select(I.CHUNK).distinct().collect()} == set(range(9))
    halo = b.rows.filter(I.HALO_ROW).groupBy(I.CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()
    assert all((r.n, r.lo, r.hi) == (min(I.HALO, 100 * r[I.CHUNK]), max(1, 100 * r[I.CHUNK] - I.HALO + 1), 100 * r[I.CHUNK]) for r in halo if r[I.CHUNK] <= 8)
    spread = own.repartition(8, I.SERIES_KEY, I.CHUNK).groupBy(F.spark_partition_id()).count().count()
    assert spread >= 4


def test_block_steps_are_sequential_steps(spark):
    """The numpy block gives bit for bit what a plain loop over the bars gives."""
    import numpy as np

    x = np.array([100 + math.sin(i) * 9 for i in range(700)])
    number, opens = np.concatenate([np.arange(1, 401), np.arange(1, 301)]), np.zeros(700, bool)
    opens[[0, 400]] = True
    rounds = {"e": ("x", "ema", 12, 1), "w": ("x", "wilder", 14, 2)}
    e, w = I.smooth_block(rounds, number, opens, [x, x], [np.zeros(700)] * 2)
    for lo, hi in ((0, 400), (400, 700)):
        ema, total, y = x[lo], 0.0, None
        assert e[lo] == ema and np.isnan(w[lo:lo + 14]).all()
        for k in range(1, hi - lo):
            v = x[lo + k]
            ema = 2.0 / 13 * v + (1.0 - 2.0 / 13) * ema
            total = total + v if k <= 14 else total
            y = total / 14 if k == 14 else (y * 13 + v) / 14 if k > 14 else None
            assert e[lo + k] == ema and (y is None or w[lo + k] == y)


def test_frames_skip_missing_values_and_stay_in_their_series():
    import numpy as np

    rng = np.random.default_rng(5)
    number = np.concatenate([np.arange(1, 61), np.arange(1, 31)])
    x, ok = rng.random(90) * 100, rng.random(90) > 0.2
    ok[60:85] = False
    given, valid = {c: np.where(ok, x, 0.0) for c in ("close", "volume", "_tp")}, {c: ok for c in ("close", "volume", "_tp")}
    opens = number == 1
    made = I.frame_block(list(I.FRAMES), number, opens, given, valid)
    for i, n in enumerate(number):
        for name, (kind, _, size) in I.FRAMES.items():
            values, missing = made[name]
            rows = [j for j in range(i - size + 1, i + 1) if j >= 0 and ok[j]]
            assert missing[i] == (n < size or not rows), (name, i)
            if missing[i]:
                continue
            total = 0.0
            for j in rows:
                total += x[j]
            center = total / (len(rows) if kind in ("mean", "deviation") else size)
            want = {"mean": center, "share": center, "deviation": math.sqrt(sum((x[j] - center) ** 2 for j in rows) / size),
                    "distance": sum(abs(x[j] - center) for j in rows) / size}[kind]
            assert values[i] == pytest.approx(want, rel=1e-12), (name, i)
            if kind in ("mean", "share"):
                assert values[i] == want


def test_frames_end_where_a_chunk_begins():
    import numpy as np

    x, yes = np.arange(1.0, 51.0), np.ones(50, dtype=bool)
    opens = np.isin(np.arange(50), (0, 25))
    number = np.arange(2, 52)  # the first bar lacks
    mean, missing = I.frame_block(["sma_20"], number, opens, {"close": x}, {"close": yes})["sma_20"]
    assert list(missing) == [n < 20 for n in number]
    assert mean[18] == sum(x[:19]) / 19 and mean[25] == x[25] and mean[49] == sum(x[30:]) / 20


def test_frame_sums_are_not_taken_from_lists_or_windows(spark):
    """A window adds up all bars of a frame for every row, and an expression in a lambda runs for every element."""
    import __spark_entry__ as E

    for name in ("ind_cci", "ind_sma", "ind_bollinger", "indicators_all"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "lambda" not in plan and "-199" not in plan, name


def test_stored_indicators_belong_to_their_table_set(spark, tmp_path):
    """A table set over the same folder sees what lies there now."""
    import shutil

    from tickframe.sources.catalog import MarketTables

    src = "/root/testdata/sf0.001"
    for name in ("region", "nation", "supplier"):
        shutil.copy(f"{src}/{name}.parquet", tmp_path)
    lines = spark.read.parquet(f"{src}/lineitem.parquet")
    lines.filter("l_suppkey = 1").write.parquet(f"{tmp_path}/lineitem.parquet")
    one = MarketTables(spark, str(tmp_path))
    assert {r[0] for r in one.indicators.select("symbol_id").distinct().collect()} == {1}
    assert one.indicators is one.indicators
    lines.filter("l_suppkey = 2").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert {r[0] for r in MarketTables(spark, str(tmp_path)).indicators.select("symbol_id").distinct().collect()} == {2}


def test_chunks_of_a_series_with_a_bar_without_time(spark):
    """The bar without a time gets the first number and then falls out; the others keep theirs."""
    rows = [(7, "1d", None if i == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "s", *[50.0 + i % 7] * 4, 10 + i) for i in range(60)]
    bars = I.series_bars(spark.createDataFrame(rows, "symbol_id int, time_frame string, t_stamp timestamp, data_source string, "
                                                     "open double, high double, low double, close double, volume bigint"))
    got = {r["t_stamp"]: r["volume_sma_20"] for r in I.all_indicators(bars, chunk_bars=16).collect()}
    at = lambda i: got[dt.datetime(2024, 1, 1) + dt.timedelta(days=i)]
    assert len(got) == 59 and at(18) is None and at(30) == round(sum(10 + i for i in range(11, 31)) / 20)
    assert at(19) == 20  # nineteen bars, of 11 to 29
