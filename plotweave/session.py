"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "plotweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; `conf` wins over the defaults.

    Underscores in keyword names stand for dots. Cluster sizes (shuffle
    partitions, memory, master) belong to spark-submit; nothing is forced here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
