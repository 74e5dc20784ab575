"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, removed when the process ends.

    Only a local session may do without that setting and then has a folder in /tmp; on a cluster executors would
    not see each other's files there.
    """
    root = spark.conf.get("spark.symloom.scratch", None)
    if root:
        return root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    root = f"{shared or 'file:///tmp'}/symloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    spark.conf.set("spark.symloom.scratch", root)
    atexit.register(discard, spark, root)
    return root


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that Spark uses for it."""
    with contextlib.suppress(Exception):  # the session may be gone; what is left is a temporary folder
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of finished plans now; else they stay until the driver happens to collect garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives the memory that a task is done with back, as its worker lives on and executors have two of them or more."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # of glibc
        ctypes.CDLL(None).malloc_trim(0)


_passing: list[str] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` writes inside is removed at the end; what ``keep`` writes stays."""
    _passing.append(f"{scratch_root(spark)}/passing-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        discard(spark, _passing.pop())


def keep(df: DataFrame) -> DataFrame:
    """``cut`` that outlives ``passing``."""
    return _written(df, scratch_root(df.sparkSession))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read back: iterations keep short plans and survive lost executors."""
    return _written(df, _passing[-1] if _passing else scratch_root(df.sparkSession))


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of rows of 16 bytes, broadcast below 16 MB."""
    return F.broadcast(df) if df.count() * 16 <= 16 << 20 else df


def _written(df: DataFrame, root: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
