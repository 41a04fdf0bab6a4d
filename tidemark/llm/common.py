"""Shared helpers of the pipeline operators."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SERIAL = itertools.count()
_HELD: dict = {}
_WRITTEN: list[str] = []


def held(key, make):
    """What a Python worker keeps between tasks. It keeps one thing: another key takes the first one's place and memory."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()  # what was held may refer to itself
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Hand memory that is free again to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(spark: SparkSession) -> None:
    """Hand back what the driver no longer needs: frames that nothing names hold plans, and generated code, in its JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session says otherwise than Spark's default of 10 000: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset, a session on one machine (tests, a
    local run) uses its warehouse folder; on a cluster that may be a local folder, and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    tag = f"{spark.sparkContext.applicationId}-{next(_SERIAL)}"
    return f"{root.rstrip('/')}/tidemark-{label}-{tag}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``materialise`` wrote in this application; frames that read them are of no use any more."""
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by a table written to the shared folder; lost executors lose nothing. ``clear`` deletes these tables."""
    short_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(frames: Iterator, chars: int = 1_500_000) -> Iterator:
    """Cut Arrow record batches so that one piece holds about ``chars`` bytes.

    A single longer row is a piece of its own: texts are never cut here.
    """
    for batch in frames:
        n = batch.num_rows
        size = max(1, batch.nbytes)
        step = max(1, min(n, n * chars // size)) if n else 1
        for at in range(0, n, step):
            yield batch.slice(at, step)
    give_back()
