"""Per-directory table set: one place that builds each market table once per query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from . import tables as TB


class MarketTables:
    """Lazily derived market tables over one input directory (all plans, no actions)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def symbols(self) -> DataFrame:
        return TB.symbols(self.spark, self.sf_dir)

    @cached_property
    def candles(self) -> DataFrame:
        return TB.market_data(self.spark, self.sf_dir)

    def candles_of(self, symbol_id: int) -> DataFrame:
        """One symbol's candles, filtered at the scan."""
        return TB.market_data(self.spark, self.sf_dir, symbol_id)

    def prices_of(self, symbol_id: int) -> DataFrame:
        """One symbol's latest prices, filtered at the scan."""
        return TB.real_time_prices(self.spark, self.sf_dir, self.symbols, symbol_id)

    def store_candles(self) -> None:
        """Write the candles once, for a query that reads them several times."""
        from ..operators import merge as M

        self.candles = M.staged(self.candles, "candles", keep=True)

    def store_prices(self) -> None:
        """Write the latest prices once, for a query that reads them several times."""
        from ..operators import merge as M

        self.prices = M.staged(self.prices, "prices", keep=True)

    @cached_property
    def stored_symbols(self) -> DataFrame:
        """The symbols written once. Spark cannot tell the size of the join that they come from; that of the
        files it knows, and so whether joining them takes a shuffle of the other side."""
        from ..operators import merge as M

        return M.staged(self.symbols, "symbols", keep=True)

    @cached_property
    def ticks(self) -> DataFrame:
        return TB.ticks(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        return TB.real_time_prices(self.spark, self.sf_dir, self.symbols)

    @cached_property
    def pairs(self) -> DataFrame:
        return TB.pairs(self.spark, self.sf_dir)

    @cached_property
    def pair_requests(self) -> DataFrame:
        return TB.pair_requests(self.spark, self.sf_dir)

    @cached_property
    def indicators(self) -> DataFrame:
        """The stored technical_indicators table: computed from this table set and written once, scanned by
        every reader after that. Values stay doubles here, so that readers see what was computed;
        ``merge.to_storage`` gives the declared decimals."""
        from ..operators import indicators as I
        from ..operators import merge as M
        from ..session import scratch, staging_path

        path = staging_path(self.spark, "technical_indicators")
        with scratch(self.spark):
            M.publish(I.technical_indicators(self.candles).select(*S.TECHNICAL_INDICATORS.fieldNames()), path)
        return self.spark.read.schema(S.TECHNICAL_INDICATORS).parquet(path)

    @cached_property
    def sessions(self) -> DataFrame:
        return TB.market_sessions(self.spark)

    @cached_property
    def data_sources(self) -> DataFrame:
        return TB.data_sources(self.spark)
