"""tickframe: a PySpark-native market-data engine (tables, reads, merges, indicators, streams)."""

__version__ = "0.1.0"
