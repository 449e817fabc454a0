"""Pair/symbol text functions and time functions on literal rows."""

from pyspark.sql import functions as F

from tickframe.functions import pairs as FP
from tickframe.functions import timeframes as FT


def _map(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_normalize_pair(spark):
    got = _map(spark, FP.normalize_pair, ["btc/usd", "BTC-USDT", "BTC", "BTC/EUR", "eth-usd", "xdg/usd"])
    assert got == ["XBTUSD", "XBTUSDT", "XBT", "BTCEUR", "ETHUSD", "XDGUSD"]


def test_infer_symbol_and_currency(spark):
    vals = ["XBTUSD", "XBTUSDT", "DOGEUSD", "MATICEUR", "ETHUSD", "ATOMGBP", "ADAGBP", "BTC/EUR"]
    got = _map(spark, FP.infer_symbol, vals)
    assert got == ["BTCUSD", "BTC/USDT", "DOGE/USD", "MATIC/EUR", "ETHUSD", "ATOM/GBP", "ADAGBP", "BTC/EUR"]
    assert _map(spark, FP.currency_of, got) == ["USD", "USD", "USD", "EUR", "USD", "EUR", "EUR", "EUR"]


def test_pair_to_symbol_map(spark):
    assert _map(spark, FP.pair_to_symbol, ["XBTUSD", "ALGOUSDT", "DOGEUSD"]) == ["BTC/USD", "ALGO/USDT", "DOGEUSD"]


def test_search_terms_aliases():
    assert FP.search_terms("DOGE") == ["doge", "xdg"]
    assert FP.search_terms("btc") == ["btc", "xbt"]
    assert FP.search_terms("btcxbt") == ["btcxbt"]
    assert FP.search_terms("eth") == ["eth"]


def test_search_and_status_filters(spark):
    pairs = spark.createDataFrame(
        [("XXBTZUSD", "XBT/USD", "XBTUSD", "XXBT", "ZUSD", "online"),
         ("XDGUSD", None, "XDGUSD", "XDG", "ZUSD", "online"),
         ("ETHUSD", "ETH/USD", "ETHUSD", "XETH", "ZUSD", "cancel_only")],
        "pair string, wsname string, altname string, base string, quote string, status string")
    hit = lambda s, st: sorted(r.pair for r in pairs.filter(FP.status_filter(st) & FP.matches_search(s)).collect())
    assert hit("doge", "online") == ["XDGUSD"]
    assert hit("BTC", "online") == ["XXBTZUSD"]
    assert hit("usd", "all") == ["ETHUSD", "XDGUSD", "XXBTZUSD"]
    assert hit(None, None) == ["ETHUSD", "XDGUSD", "XXBTZUSD"]
    assert hit("eth", "online") == []


def test_timeframe_minutes(spark):
    assert _map(spark, FT.timeframe_minutes, ["1m", "4h", "1d", "1w", "1M", "2h", None]) == [
        1, 240, 1440, 10080, 21600, 60, 60]


def test_iso_roundtrip(spark):
    df = spark.createDataFrame([("2024-01-05T10:15:30Z",), ("2024-01-05T10:15:30.250000+00:00",)], "s string")
    out = df.select(FT.parse_iso(F.col("s")).alias("t")).select(FT.to_iso(F.col("t"))).collect()
    assert [r[0] for r in out] == ["2024-01-05T10:15:30.000000+00:00", "2024-01-05T10:15:30.250000+00:00"]


def test_month_partition_and_ahead(spark):
    df = spark.createDataFrame([("2024-12-31 23:59:59",)], "s string").select(F.col("s").cast("timestamp").alias("t"))
    r = df.select(FT.month_partition(F.col("t")), FT.months_ahead(F.col("t"), 1)).first()
    assert r[0] == "2024_12" and str(r[1]) == "2025-01-01"
