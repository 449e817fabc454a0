"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root, fresh_path

#: A-Z and a-z for ``translate``: lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters (``[\x20\x09-\x0D]``).
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, *parted: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    Cuts the lineage with files that outlive any executor; later jobs read the columns they
    need and nothing above is computed again. ``parted`` names columns to have a folder each.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*parted).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound an Arrow batch by bytes: a batch of very long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def byte_pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, cut at spaces, so that words stay whole and a
    very long text is never split into all its words at once."""
    start = 0
    while len(raw) - start > size:
        cut = raw.find(b" ", start + size)
        if cut < 0:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:] if start else raw


__all__ = ["UPPER", "LOWER", "BLANKS", "read", "staged", "small_batches", "byte_pieces", "checkpoint_root", "fresh_path"]
