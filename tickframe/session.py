"""Session helpers: UTC clock, AQE, shared work folder for checkpoints and staged tables, what is kept on disk."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Timestamps are compared as UTC instants, so the
# session zone is pinned; AQE re-plans joins/aggregates from runtime sizes.
_REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# What a shuffle's task reads. AQE cuts a shuffle into many small partitions and joins neighbours up to the
# advisory size, so a task's memory follows that size and not how many partitions the session starts with.
# Set where the session leaves Spark's own values (few partitions, 64 MB each: gigabytes of hash tables).
_PARTITION_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

# Spark keeps the shuffle files of a finished query until its driver collects garbage, so a job of several
# queries holds the files of all of them. Set where the session leaves it open.
_CLEANUP_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: What the library writes as Parquet: takes two thirds of Spark's default (snappy) for text and candles.
PARQUET = {"compression": "zstd"}

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # shuffle files and spills take about two thirds of lz4's
    "spark.io.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Streaming state off the JVM heap with incremental (changelog) checkpoints: state per
    # key stays bounded in memory however many keys a stream accumulates.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def default_driver_memory(cap_gb: int = 8) -> str:
    """About 60% of physical memory, at most ``cap_gb``: local mode runs everything in the
    driver JVM, and a heap larger than the machine would be killed instead of spilling."""
    try:
        total = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
        gb = max(1, min(cap_gb, int(total * 0.6 / 2 ** 30)))
    except (ValueError, OSError, AttributeError):
        gb = 2
    return f"{gb}g"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tickframe",
                  extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, pass the cluster's own session instead."""
    b = SparkSession.builder.master(master).appName(app)
    conf = {**_DEFAULT_CONF, **_REQUIRED_CONF,
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": default_driver_memory()}
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Pin the settings the library needs on a session it did not create."""
    for k, v in _REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in {**_PARTITION_CONF, **_CLEANUP_CONF}.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, stream checkpoints and staged tables.

    Uses ``spark.checkpoint.dir`` from the session (the cluster's shared store). Only when
    it is unset on a single-JVM session (local runs, tests) a fresh scratch folder is created
    and recorded; on a cluster an unset folder is an error, because a machine-local one would
    lose data without notice.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tickframe-ckpt-", dir=os.environ.get("TICKFRAME_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never-before-used path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------- staged tables
#: Folder of the scratch that is open in this thread.
_SCRATCH: ContextVar[str | None] = ContextVar("tickframe_scratch", default=None)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what the library staged at ``path``, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is staged inside is deleted at the end: for steps whose results are written by then. A frame that
    is handed on unread has to be staged with ``keep``."""
    path = fresh_path(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        discard(spark, path)


def staging_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the open scratch; with ``keep``, or where none is open, beside it for good."""
    inside = None if keep else _SCRATCH.get()
    return f"{inside}/{name}-{uuid.uuid4().hex[:12]}" if inside else fresh_path(spark, name)


def staged(df: DataFrame, name: str, keep: bool = False, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder (at ``path`` of ``staging_path``) and read back: later steps neither
    compute it again nor depend on an executor."""
    path = path or staging_path(df.sparkSession, name, keep)
    df.write.options(**PARQUET).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
