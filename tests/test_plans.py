"""Physical-plan properties the scale design relies on (checked on the formatted plan)."""

import contextlib
import io

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tree(plan: str) -> str:
    return plan.split("\n\n(1)")[0]


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_indicators_shuffle_the_stored_bars_once(spark, q):
    tree = _tree(_plan(q["indicators_all"](spark, SF_SMALL)))
    assert tree.count("Exchange") == 1, tree       # by series; the bars were written once before
    assert tree.count("MapInArrow") == 2 and "Window" in tree
    assert tree.count("Sort") == 1, tree           # the recurrences take the windows' order


def test_bucketed_candles_are_grouped_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from tickframe.operators import merge as M
    from tickframe.session import fresh_path
    from tickframe.sources.catalog import MarketTables

    t = MarketTables(spark, SF_SMALL)
    table = M.write_bucketed(t.candles, "bucketed_test", fresh_path(spark, "bucketed"), buckets=4)
    assert "Exchange" not in _tree(_plan(table.groupBy("symbol_id").agg(F.max("close"))))
    other = M.write_bucketed(t.candles.filter("symbol_id < 5"), "bucketed_other", fresh_path(spark, "bucketed"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = table.select("symbol_id", "close").join(other.select("symbol_id", "t_stamp"), "symbol_id")
        assert "Exchange" not in _tree(_plan(joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert table.count() == t.candles.count()
    spark.sql("DROP TABLE bucketed_test")
    spark.sql("DROP TABLE bucketed_other")


def test_documents_are_not_parsed_again(spark, q):
    assert "parse_json" not in _plan(q["ohlc_decode"](spark, SF_SMALL))
    assert "parse_json" not in _plan(q["ticker_decode"](spark, SF_SMALL))
    assert "parse_json" not in _plan(q["pairs_explode"](spark, SF_SMALL))


def test_gaps_alone_are_expanded(spark, q):
    tree = _tree(_plan(q["missing_bars"](spark, SF_SMALL)))
    assert "Window" in tree and "Generate" in tree and "Join" not in tree


def test_readers_scan_the_stored_indicator_table(spark, q):
    for name in ("indicators_with_symbols", "candles_left_indicators", "candles_left_indicators_all"):
        tree = _tree(_plan(q[name](spark, SF_SMALL)))
        assert "MapInArrow" not in tree and "Window" not in tree, name


def test_range_filter_reaches_the_scan(spark, q):
    plan = _plan(q["candles_range"](spark, SF_SMALL))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln and "l_shipdate" in ln]
    assert pushed and "GreaterThanOrEqual(l_shipdate" in pushed[0] and "LessThanOrEqual(l_shipdate" in pushed[0]


def test_stored_candles_prune_partitions(spark, q):
    plan = _plan(q["candles_stored_range"](spark, SF_SMALL))
    part = [ln for ln in plan.splitlines() if "PartitionFilters" in ln]
    assert part and "year_month" in part[0] and "time_frame" in part[0]


def test_symbol_join_has_no_hint_and_scan_is_pruned(spark, q):
    df = q["candles_with_symbols"](spark, SF_SMALL)
    assert df._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 2   # nation and region only
    plan = _plan(df)
    schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "l_orderkey" in ln][0]
    assert "l_discount" not in schema and "l_tax" not in schema and "l_linestatus" not in schema


def test_point_read_filters_before_aggregating(spark, q):
    plan = _plan(q["candles_latest"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan
    assert any("EqualTo(l_suppkey,7)" in ln for ln in plan.splitlines() if "PushedFilters" in ln)
    prices = _plan(q["prices_by_symbol"](spark, SF_SMALL))
    assert any("EqualTo(user_id,7)" in ln for ln in prices.splitlines() if "PushedFilters" in ln)


def test_merge_counts_scan_each_side_once(spark, q):
    tree = _tree(_plan(q["merge_metrics"](spark, SF_SMALL)))
    assert tree.count("Scan parquet") == 3, tree   # target, incoming and its conflicting copies


def test_top_n_per_series_limits_before_the_shuffle(spark, q):
    tree = _tree(_plan(q["candles_latest_per_symbol"](spark, SF_SMALL)))
    lines = [ln.strip("+-: ") for ln in tree.splitlines()]
    ex = next(i for i, ln in enumerate(lines) if ln.startswith("Exchange"))
    assert any(ln.startswith("WindowGroupLimit") for ln in lines[ex + 1:])   # partial, map side
    assert any(ln.startswith("WindowGroupLimit") for ln in lines[:ex])       # final


def test_shuffles_start_small_where_the_session_sets_nothing(spark, q):
    import re

    parts = re.findall(r"hashpartitioning\([^)]*, (\d+)\)", _plan(q["merge_metrics"](spark, SF_SMALL)))
    assert parts and set(parts) == {"1000"}, parts     # AQE joins them up to the advisory size
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert spark.conf.get(key) == "16m"
    spark.conf.set(key, "32m")
    try:
        q["merge_metrics"](spark, SF_SMALL)
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.set(key, "16m")


def test_times_are_made_distinct_without_grouping_the_candles_first(spark, q):
    tree = _tree(_plan(q["missing_bars"](spark, SF_SMALL)))
    assert tree.count("Exchange") == 3, tree   # weeks, months, then the series


def test_added_prices_are_read_back_not_decoded_again(spark):
    from pyspark.sql import functions as F

    from tickframe import schemas as S
    from tickframe.functions import payload as PL
    from tickframe.operators import merge as M
    from tickframe.sources.catalog import MarketTables

    t = MarketTables(spark, SF_SMALL)
    docs = PL.landed_documents(spark.createDataFrame([('{"error":[],"result":{"P1":{"c":["2","1"]}}}',)], "value string"))
    pairs = spark.createDataFrame([("P1", None, "online")], "pair string, altname string, status string")
    prices = spark.createDataFrame([], S.REAL_TIME_PRICES)
    requests = spark.createDataFrame([("p1",)], "requested string")
    _, symbols, priced = M.add_pairs(requests, pairs, t.symbols, PL.decode_ticker(docs), prices, F.lit("2024-01-01").cast("timestamp"))
    assert "variant_get" not in _plan(priced)
    assert [(r.price, r.action) for r in priced.collect()] == [(2.0, "insert")]
