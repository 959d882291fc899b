"""Tables written in the shared folder between steps of iterative jobs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class _Scratch(threading.local):
    """Paths staged inside each open `scratch` of a thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; local sessions may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="plotweave-"))
    return _LOCAL[0]


#: Share of the driver's heap from which finished jobs' leftovers are collected.
_TIDY_FROM = 0.3


def _tidy(spark: SparkSession) -> None:
    """Spark frees shuffle files and broadcasts of finished jobs when the driver's JVM collects their handles: see to it in time.

    Iterative jobs leave many; a driver with little memory would otherwise fill it before it collects.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > _TIDY_FROM * heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends, lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/plotweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(path)
    _tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; results that read it must be written by then."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            remove(spark, path)
