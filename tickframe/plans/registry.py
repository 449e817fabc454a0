"""Registry of named queries: Spark plan builder + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import MarketTables
from .oracle import with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Parameters of the registered forms (values present at every scale factor).
SYMBOL = "Supplier#000000007"
TIME_FRAME = "1d"
RANGE_LO = "1998-01-01 00:00:00"
RANGE_HI = "1998-03-31 00:00:00"


def query(name: str, sql: str | None = None):
    """Register ``fn(t: MarketTables) -> DataFrame`` under ``name`` (with its oracle SQL)."""
    def deco(fn: Callable[[MarketTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(MarketTables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_adapters(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_reads, q_pairs, q_candles, q_indicators, q_merge, q_quality, q_stream  # noqa: F401
