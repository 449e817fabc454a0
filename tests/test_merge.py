"""Merges and CRUD on literal rows (the reference's own test literals where it has them)."""

import datetime as dt

from pyspark.sql import functions as F

from tickframe import schemas as S
from tickframe.operators import joins as J
from tickframe.operators import merge as M
from tickframe.operators import reads as R

def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")

def _symbols(spark):
    rows = [(1, "AAA", "A", "NYSE", "stock", "USD", "Tech", "Soft", 10, True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)),
            (2, "BBB", "B", "NYSE", "stock", "USD", None, None, None, False, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, S.SYMBOLS)

def test_create_update_delete_symbol(spark):
    syms = _symbols(spark)
    inc = spark.createDataFrame(
        [("TEST", "Test Symbol", "TEST_EXCHANGE", "stock", "USD", "Technology", "Software", 1000000000, True),
         ("AAA", "dup", "X", "stock", None, None, None, None, None),
         ("NEW", "n1", "X", "crypto", None, None, None, None, None),
         ("NEW", "n2", "X", "crypto", None, None, None, None, None)],
        "symbol string, name string, exchange string, asset_type string, currency string, sector string, "
        "industry string, market_cap bigint, is_active boolean")
    created, rejected = M.create_symbols(syms, inc, _now())
    c = {r.symbol: r for r in created.collect()}
    assert set(c) == {"TEST", "NEW"}
    assert c["NEW"].currency == "USD" and c["NEW"].is_active is True and c["NEW"].name == "n1"
    assert sorted(r.id for r in created.collect()) == [3, 4]
    assert sorted((r.symbol, r.reason) for r in rejected.collect()) == [("AAA", "duplicate_symbol"),
                                                                        ("NEW", "duplicate_in_batch")]
    table = syms.unionByName(created)
    ch = spark.createDataFrame([("TEST", "Updated Test Symbol", "Finance", "Banking", 2000000000)],
                               "symbol string, name string, sector string, industry string, market_cap bigint")
    upd = {r.symbol: r for r in M.update_symbols(table, ch, _now()).collect()}
    assert (upd["TEST"].name, upd["TEST"].sector, upd["TEST"].industry, upd["TEST"].market_cap) == (
        "Updated Test Symbol", "Finance", "Banking", 2000000000)
    assert upd["AAA"].name == "A"
    out = M.delete_symbols(table, F.col("symbol") == "TEST")
    assert R.symbol_lookup(out["symbols"], "TEST").count() == 0

def test_update_replace_nulls_missing_fields(spark):
    ch = spark.createDataFrame([("AAA", "A2")], "symbol string, name string")
    r = {x.symbol: x for x in M.update_symbols(_symbols(spark), ch, _now(), replace=True).collect()}["AAA"]
    assert (r.name, r.sector, r.industry, r.market_cap) == ("A2", None, None, None)
    r = {x.symbol: x for x in M.update_symbols(_symbols(spark), ch, _now()).collect()}["AAA"]
    assert (r.name, r.sector, r.industry, r.market_cap) == ("A2", "Tech", "Soft", 10)

def _candles(spark, rows):
    return spark.createDataFrame(
        [(i, s, dt.datetime(2024, 1, d), o, h, lo, c, v, None, tf, src, None) for i, s, d, o, h, lo, c, v, tf, src in rows],
        S.MARKET_DATA)

def test_insert_ignore_first_writer_wins_and_idempotent(spark):
    target = _candles(spark, [(1, 1, 1, 100.5, 105.25, 99.75, 103.0, 1000000, "1d", "test")])
    inc = _candles(spark, [(2, 1, 1, 1.0, 1.0, 1.0, 1.0, 1, "1d", "test"),      # conflicts with target
                           (3, 1, 2, 5.0, 6.0, 4.0, 5.5, 10, "1d", "test"),
                           (4, 1, 2, 9.0, 9.0, 9.0, 9.0, 99, "1d", "test")])     # later duplicate in batch
    once = M.insert_ignore_table(target, inc, M.CANDLE_KEY, ["id"])
    assert sorted((r.id, r.close) for r in once.collect()) == [(1, 103.0), (3, 5.5)]
    twice = M.insert_ignore_table(once, inc, M.CANDLE_KEY, ["id"])
    assert sorted(r.id for r in twice.collect()) == [1, 3]

def test_upsert_prices_replaces_fields_keeps_id(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    target = spark.createDataFrame([(10, 1, 150.75, 150.70, 150.80, 5000000, 2.5, 1.68, 10 ** 12, "test", t0, t0)],
                                   S.REAL_TIME_PRICES)
    inc = spark.createDataFrame([(99, 1, 105.5, None, None, None, None, None, None, "test", t1, t1),
                                 (98, 2, 7.0, None, None, None, None, None, None, "test", t1, t1)], S.REAL_TIME_PRICES)
    out = {r.symbol_id: r for r in M.upsert_prices(target, inc).collect()}
    assert out[1].id == 10 and out[1].price == 105.5 and out[1].bid is None and out[1].market_cap is None
    assert out[1].created_at == t0 and out[1].last_updated == t1 and out[1].action == "update"
    assert out[2].action == "insert" and out[2].id == 98
    again = {r.symbol_id: r for r in M.upsert_prices(M.upsert_prices(target, inc).drop("action"), inc).collect()}
    assert again[1].price == 105.5 and again[2].id == 98

def test_validation_rejects_bad_rows(spark):
    rows = _candles(spark, [(1, 1, 1, -100.0, 1.0, 1.0, 1.0, 1, "1d", "x"), (2, 1, 2, 1.0, 1.0, 1.0, 1.0, -1, "2d", "x"),
                            (3, 1, 3, 100.0, 110.0, 95.0, 105.0, 0, "1M", "x")])
    ok, bad = R.validate_candles(rows)
    assert [r.id for r in ok.collect()] == [3]
    v = {r.id: r.violations for r in bad.collect()}
    assert v[1] == ["open_not_positive"] and v[2] == ["volume_negative", "bad_time_frame"]

def test_unknown_symbol_is_unresolved(spark):
    inc = spark.createDataFrame([("INVALID_SYMBOL_XYZ123", 1.0), ("AAA", 2.0)], "symbol string, price double")
    assert [r.symbol for r in J.unresolved_symbols(inc, _symbols(spark)).collect()] == ["INVALID_SYMBOL_XYZ123"]
    res = {r.symbol: r.symbol_id for r in J.resolve_symbols(inc, _symbols(spark)).collect()}
    assert res == {"INVALID_SYMBOL_XYZ123": None, "AAA": 1}

def test_assign_ids_dense_and_unique(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    ids = [r.id for r in M.assign_ids(df, ["k"], base=100, buckets=64).collect()]
    assert sorted(ids) == list(range(101, 5101))

def test_paging_has_no_overlap_and_limit_first(spark):
    from tickframe.sources.tables import symbols

    syms = symbols(spark, "/root/testdata/sf0.01")
    p1 = R.symbols_page(syms, 5, 0).select("id")
    p2 = R.symbols_page(syms, 5, 5).select("id")
    assert p1.count() == 5 and p2.count() == 5 and p1.intersect(p2).count() == 0
    filtered = R.symbols_filtered(syms, is_active=True, asset_type="crypto", limit=5)
    late = R.symbols_filtered(syms, is_active=True, asset_type="crypto", limit=5, limit_first=True)
    assert filtered.count() == 5 and late.count() <= 5
    assert {r.id for r in late.collect()} <= {r.id for r in R.symbols_page(syms, 5).collect()}


def test_stored_candles_prune_months(spark):
    import contextlib
    import io

    from tickframe.session import fresh_path
    from tickframe.sources.tables import market_data

    path = M.write_candles(market_data(spark, "/root/testdata/sf0.001"), fresh_path(spark, "md-test"))
    df = R.time_range(M.read_candles(spark, path), "1998-01-01 00:00:00", "1998-02-15 00:00:00")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters" in plan and "year_month" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "PushedFilters" in plan and "t_stamp" in plan.split("PushedFilters")[1].split("\n")[0]
    months = {r.year_month for r in df.select("year_month").distinct().collect()}
    assert months == {"1998-01", "1998-02"}
    assert dict(M.read_candles(spark, path).dtypes)["open"] == "decimal(20,8)"


def test_bad_price_is_quarantined(spark):
    rows = spark.createDataFrame([("AAPL", -100.0), ("AAPL", 105.5), ("X", None)], "symbol string, price double")
    ok, bad = R.validate_prices(rows)
    assert [r.price for r in ok.collect()] == [105.5]
    assert sorted((r.price, tuple(r.violations)) for r in bad.collect() if r.price is not None) == [
        (-100.0, ("price_not_positive",))]
    assert bad.count() == 2


def test_apply_sync_creates_and_flips_is_active(spark):
    pairs = spark.createDataFrame([("AAA", "A-alt", "cancel_only"), ("NEWUSD", "NEW", "online"), ("CCC", "C", "online")],
                                  "pair string, altname string, status string")
    mapping = spark.createDataFrame([("AAA", "AAA"), ("NEWUSD", "NEW/USD"), ("ZZZ", "ZZZ")], "pair string, db_symbol string")
    syms = _symbols(spark)
    plan = {r.pair: r for r in M.sync_plan(mapping, pairs, syms).collect()}
    assert set(plan) == {"AAA", "NEWUSD"}                         # ZZZ is not offered
    assert plan["AAA"].action == "update" and plan["AAA"].is_active is False
    assert plan["NEWUSD"].action == "create" and plan["NEWUSD"].name == "NEW"
    out = {r.symbol: r for r in M.apply_sync(M.sync_plan(mapping, pairs, syms), syms, _now()).collect()}
    assert out["AAA"].is_active is False and out["AAA"].name == "A"
    assert out["NEW/USD"].exchange == "Kraken" and out["NEW/USD"].is_active is True and out["NEW/USD"].id == 3
    assert out["BBB"].is_active is False


def test_missing_bars_listing(spark):
    from tickframe.operators import quality as Q

    c = _candles(spark, [(1, 1, d, 1.0, 1.0, 1.0, 1.0, 1, "1d", "x") for d in (1, 2, 5, 6)])
    missing = sorted(r.t_stamp.day for r in Q.missing_bars(c).collect())
    assert missing == [3, 4]
    g = Q.gap_summary(c).first()
    assert (g.expected, g.present, g.missing) == (6, 4, 2)


def test_candles_latest_filter_first_vs_limit_first(spark):
    from tickframe.sources.tables import market_data, symbols

    c, s = market_data(spark, "/root/testdata/sf0.001"), symbols(spark, "/root/testdata/sf0.001")
    lo, hi = "1996-01-01 00:00:00", "1996-12-31 00:00:00"
    first = R.candles_latest(c, s, "Supplier#000000007", "1d", limit=10, lo=lo, hi=hi)
    late = R.candles_latest(c, s, "Supplier#000000007", "1d", limit=10, lo=lo, hi=hi, limit_first=True)
    rows = first.collect()
    assert len(rows) == 10 and all(dt.datetime(1996, 1, 1) <= r.t_stamp <= dt.datetime(1996, 12, 31) for r in rows)
    assert [r.t_stamp for r in rows] == sorted((r.t_stamp for r in rows), reverse=True)
    assert late.count() == 0          # the newest 10 bars are after 1996: the reference's order returns nothing
    edge = R.candles_latest(c, s, "Supplier#000000007", "1d", limit=1000, lo=rows[-1].t_stamp, hi=rows[0].t_stamp)
    assert {r.t_stamp for r in rows} <= {r.t_stamp for r in edge.collect()}   # both ends inclusive


def test_upsert_takes_rows_without_an_id(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    target = spark.createDataFrame([(10, 1, 150.75, 1.0, 2.0, 3, 2.5, 1.68, 4, "test", t0, t0)], S.REAL_TIME_PRICES)
    inc = spark.createDataFrame([(1, 105.5, "test", t1, t1), (2, 7.0, "test", t1, t1), (3, 8.0, "test", t1, t1)],
                                "symbol_id int, price double, data_source string, last_updated timestamp, created_at timestamp")
    for c in ["bid", "ask", "change_24h", "change_percent_24h"]:
        inc = inc.withColumn(c, F.lit(None).cast("double"))
    inc = inc.withColumn("volume_24h", F.lit(None).cast("bigint")).withColumn("market_cap", F.lit(None).cast("bigint"))
    out = {r.symbol_id: r for r in M.upsert_prices(target, inc).collect()}
    assert (out[1].id, out[1].price, out[1].action) == (10, 105.5, "update")
    assert sorted((out[k].id, out[k].action) for k in (2, 3)) == [(11, "insert"), (12, "insert")]
    assert out[2].price == 7.0


def test_create_symbols_equal_rows_and_missing_names(spark):
    row = ("NEW", "n", "X", "crypto", "USD", True)
    inc = spark.createDataFrame([row, row, row, ("BAD", None, "X", "crypto", "USD", True), ("BAD", "b", "X", "crypto", "USD", True),
                                 (None, "n", "X", "crypto", "USD", True)],
                                "symbol string, name string, exchange string, asset_type string, currency string, is_active boolean")
    created, rejected = M.create_symbols(_symbols(spark), inc, _now())
    assert sorted((r.symbol, r.name) for r in created.collect()) == [("BAD", "b"), ("NEW", "n")]
    assert sorted((r.symbol or "", r.reason) for r in rejected.collect()) == [
        ("", "symbol_missing"), ("BAD", "name_missing"), ("NEW", "duplicate_in_batch"), ("NEW", "duplicate_in_batch")]


def test_update_with_repeated_changes_keeps_one_row(spark):
    ch = spark.createDataFrame([(1, "AAA", "first"), (2, "AAA", "second")], "seq int, symbol string, name string")
    out = M.update_symbols(_symbols(spark), ch, _now(), order=["seq"]).filter("symbol = 'AAA'").collect()
    assert [r.name for r in out] == ["second"]


def test_add_pairs_picks_one_offered_request(spark):
    pairs = spark.createDataFrame([("XBTEUR", "XBT/EUR", "online"), ("DOGEUSD", "D", "online")], "pair string, altname string, status string")
    req = spark.createDataFrame([("BTCEUR",), ("XBTEUR",), ("dogeusd",), ("dogeusd",)], "requested string")
    got = sorted((r.requested, r.action) for r in M.add_pairs_plan(req, pairs, _symbols(spark)).collect())
    assert got == [("BTCEUR", "not_found"), ("XBTEUR", "create"), ("dogeusd", "create"), ("dogeusd", "duplicate_in_batch")]
    given = req.limit(0).unionByName(spark.createDataFrame([("xbteur",)], "requested string")).withColumn("db_symbol", F.lit("AAA"))
    assert [r.action for r in M.add_pairs_plan(given, pairs, _symbols(spark)).collect()] == ["exists"]


def test_monthly_gaps_are_calendar_months(spark):
    from tickframe.operators import quality as Q

    rows = [(m, 1, dt.datetime(2023, m, 1), 1.0, 1.0, 1.0, 1.0, 1, None, "1M", "x", None) for m in range(1, 13)]
    c = spark.createDataFrame(rows, S.MARKET_DATA)
    g = Q.gap_summary(c).first()
    assert (g.expected, g.present, g.missing) == (12, 12, 0) and Q.missing_bars(c).count() == 0
    some = c.filter("id not in (3, 7)")
    assert Q.gap_summary(some).first().missing == 2
    assert sorted(r.t_stamp.month for r in Q.missing_bars(some).collect()) == [3, 7]


def test_ingest_rerun_appends_nothing(spark):
    from tickframe.session import fresh_path

    rows = [("XBTUSD", dt.datetime(2024, 1, d), 1.0, 2.0, 0.5, o, v, 1.0, "1d", "kraken") for d, o, v in [(1, 1.5, 3), (2, 1.5, None), (40 % 28, -1.0, 1)]]
    dec = spark.createDataFrame(rows, "pair string, t_stamp timestamp, open double, high double, low double, close double, volume bigint, "
                                      "adjusted_close double, time_frame string, data_source string")
    path = fresh_path(spark, "t-ingest")
    syms, bad, counts = M.ingest_ohlc(dec, _symbols(spark), path, _now())
    assert {r.metric: r.value for r in counts.collect()} == {"fetched": 3, "inserted": 2, "quarantined": 1}
    assert [r.violations for r in bad.collect()] == [["close_not_positive"]]
    assert syms.filter("symbol = 'BTC/USD'").count() == 1
    first = sorted(map(tuple, M.read_candles(spark, path).select("id", "volume", "t_stamp").collect()))
    assert [r[:2] for r in sorted(first, key=lambda r: r[2])] and {r[1] for r in first} == {0, 3} and {r[0] for r in first} == {1, 2}
    _, _, again = M.ingest_ohlc(dec, syms, path, _now())
    assert {r.metric: r.value for r in again.collect()}["inserted"] == 0
    assert sorted(map(tuple, M.read_candles(spark, path).select("id", "volume", "t_stamp").collect())) == first


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from tickframe.session import checkpoint_root

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        checkpoint_root(Session())


def _ohlc(spark, path, bars):
    """One delivery: a document for each list of (day, close)."""
    docs = ['{"error":[],"result":{"XBTUSD":[%s],"last":1}}' % ",".join(f'[{1704067200 + 86400 * d},"1","99","0.5","{c}","1","1",1]' for d, c in bar) for bar in bars]
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.mode("append").parquet(path)


def test_first_arrival_is_stored_however_files_are_named(spark):
    import glob
    import os
    import shutil

    from tickframe.functions import payload as PL
    from tickframe.session import fresh_path
    from tickframe.sources import payloads as SP

    landed = fresh_path(spark, "t-arrivals")
    for bars in ([[(0, 9.0), (1, 5.0), (1, 4.0)]], [[(0, 1.0)], [(2, 8.0)], [(2, 7.0)]], [[(0, 2.0), (1, 1.0), (2, 1.0)]]):
        _ohlc(spark, landed, bars)
    files = sorted(glob.glob(f"{landed}/*.parquet"), key=os.path.getmtime)
    for names in ("abc", "cba", "bca"):  # the same deliveries under other names
        folder = fresh_path(spark, "t-renamed")
        os.makedirs(folder)
        for i, (f, n) in enumerate(zip(files, names)):
            shutil.copy(f, f"{folder}/part-{n}.parquet")
            os.utime(f"{folder}/part-{n}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        docs = PL.landed_documents(SP.read_arrivals(spark, folder)).drop("value")
        decoded = PL.decode_ohlc(PL.ohlc_records(PL.split_errors(docs)[0]), "1d").drop("last")
        path = fresh_path(spark, "t-stored")
        M.ingest_ohlc(decoded.repartition(3), _symbols(spark), path, _now())
        assert [float(r.close) for r in M.read_candles(spark, path).orderBy("t_stamp").collect()] == [9.0, 5.0, 8.0]


def test_ids_are_reserved_without_a_scan(spark, monkeypatch):
    from tickframe.session import fresh_path

    path = fresh_path(spark, "t-ids")
    assert M.reserve_ids(spark, path, 5) == 0 and M.reserve_ids(spark, path, 0) == 5 and M.reserve_ids(spark, path, 2) == 5
    asked = []
    real = M.existing
    monkeypatch.setattr(M, "existing", lambda s, p, schema: asked.append(p) or real(s, p, schema))
    assert M.reserve_ids(spark, path, 1) == 7 and asked == [path + "_ids"]
    other = fresh_path(spark, "t-old")  # a table written by other means
    spark.createDataFrame([(41,), (12,)], "id bigint").write.parquet(other)
    assert M.reserve_ids(spark, other, 3) == 41 and M.reserve_ids(spark, other, 1) == 44


def test_add_pairs_creates_and_seeds_once(spark):
    pairs = spark.createDataFrame([("XBTEUR", "XBT/EUR", "online"), ("DOGEUSD", "D", "cancel_only"), ("ETHUSD", None, "online")], "pair string, altname string, status string")
    req = spark.createDataFrame([("xbt/eur",), ("DOGEUSD",), ("dogeusd",), ("ETHUSD",), ("none",)], "requested string")
    tick = lambda p, v: (p, v, 1.0, 2.0, 3, 0.5, None, "kraken")
    tickers = spark.createDataFrame([tick("XBTEUR", 10.5), tick("DOGEUSD", -1.0)],
                                    "pair string, price double, bid double, ask double, volume_24h bigint, change_24h double, change_percent_24h double, data_source string")
    empty = spark.createDataFrame([], S.REAL_TIME_PRICES)
    plan, symbols, prices = M.add_pairs(req, pairs, _symbols(spark), tickers, empty, _now())
    assert sorted((r.requested, r.action) for r in plan.collect()) == [
        ("DOGEUSD", "create"), ("ETHUSD", "create"), ("dogeusd", "duplicate_in_batch"), ("none", "not_found"), ("xbt/eur", "create")]
    got = {r.symbol: r for r in symbols.collect()}
    assert set(got) == {"AAA", "BBB", "BTCEUR", "DOGE/USD", "ETHUSD"} or "BTCEUR" in got or "BTC/EUR" in got
    assert got["DOGE/USD"].is_active is False and got["ETHUSD"].name == "ETHUSD"
    assert [(r.price, r.action) for r in prices.collect()] == [(10.5, "insert")]  # no price where the ticker has none that is valid
    plan2, symbols2, prices2 = M.add_pairs(req, pairs, symbols, tickers, prices.drop("action"), _now())
    assert {r.action for r in plan2.collect()} <= {"exists", "not_found"}
    assert symbols2.count() == symbols.count() and [r.action for r in prices2.collect()] == ["keep"]


def test_constraints_are_measured_by_the_writing_job(spark):
    from tickframe.operators import quality as Q
    from tickframe.session import fresh_path

    rows = _candles(spark, [(1, 1, 1, -1.0, 1.0, 1.0, 1.0, 1, "1d", "x"), (2, 1, 1, 1.0, 1.0, 1.0, 1.0, 1, "1d", "x"), (3, 1, 3, 1.0, 1.0, 0.0, 1.0, -1, "2d", "x")])
    paths = {}

    def write(name, df):
        paths[name] = fresh_path(spark, name)
        df.write.parquet(paths[name])
    got = {(r.table_name, r.rule): r.violations for r in Q.write_checked(spark, {"market_data": rows}, write).collect()}
    assert got["market_data", "open_not_positive"] == 1 and got["market_data", "low_not_positive"] == 1 and got["market_data", "bad_time_frame"] == 1
    assert got["market_data", "volume_negative"] == 1 and got["market_data", "symbol_id_missing"] == 0
    assert got["market_data", "duplicate_keys_dropped"] == 1 and spark.read.parquet(paths["market_data"]).count() == 2


def test_ticker_and_pair_documents_get_reasons(spark):
    import json

    from tickframe.functions import payload as PL

    raw = lambda docs: spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")
    good = {"c": ["1", "1"]}
    docs = ["x", {"error": ["E"], "result": {"P": good}}, {"error": []}, {"error": [], "result": {}},
            {"error": [], "result": {"A": good, "B": good, "C": 5, "D": {"c": ["n"]}, "E": {"c": ["1"], "b": ["?"]}, "F": {"c": ["1"], "v": ["1", "x"]}}}]
    out = sorted((r.level, r.reason) for r in PL.ticker_rejects(raw(docs)).collect())
    assert out == [("document", "error"), ("document", "malformed"), ("document", "no_pair"), ("document", "no_result"),
                   ("record", "bad_price"), ("record", "bad_quote"), ("record", "bad_ticker"), ("record", "bad_volume")]
    assert sorted(r.pair for r in PL.decode_ticker(raw(docs)).collect()) == ["A", "B"]
    docs = ["x", {"error": ["E"]}, {"error": [], "result": {"A": {"altname": "a"}, "B": 7}}]
    assert sorted((r.level, r.reason) for r in PL.pair_rejects(raw(docs)).collect()) == [("document", "error"), ("document", "malformed"), ("record", "bad_info")]
    assert [(r.pair, r.altname) for r in PL.decode_pairs(raw(docs)).collect()] == [("A", "a")]


def test_first_per_key_carries_each_column_once(spark):
    """A wide order, as an arrival, is not shuffled beside the row that holds it already."""
    import re

    df = spark.createDataFrame([(1, "b", 2, None), (1, "a", 5, 1.0), (1, "a", 3, 2.0), (2, None, 1, 7.0), (2, "z", 0, 1.0)], "k int, o string, x int, y double")
    first = M.first_per_key(df, ["k"], ["o", "x", "y"])
    assert sorted(map(tuple, first.collect())) == [(1, "a", 3, 2.0), (2, None, 1, 7.0)]
    last = M.first_per_key(df, ["k"], ["o", "x", "y"], newest=True)
    assert sorted(map(tuple, last.collect())) == [(1, "b", 2, None), (2, "z", 0, 1.0)]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"min_by|max_by", plan)
    less = M.first_per_key(df, ["k"], ["o", "x"], drop=["o", "x"])
    assert less.columns == ["k", "y"] and sorted(map(tuple, less.collect())) == [(1, 2.0), (2, 7.0)]
    maps = df.withColumn("m", F.create_map("o", "x")).filter("o IS NOT NULL")
    assert {r["m"]["a"] for r in M.first_per_key(maps, ["k"], ["o", "x"]).filter("k = 1").collect()} == {3}


def test_quality_queries_aggregate_candles_once(spark):
    from tickframe.plans import q_quality as QQ
    from tickframe.sources.catalog import MarketTables

    t = MarketTables(spark, "/root/testdata/sf0.001")
    plan = QQ.dq_nulls(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
