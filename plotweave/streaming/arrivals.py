"""Streams of arriving artefacts: completeness, progress, incremental work and arrival rates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


class Completeness(StatefulProcessor):
    """Collects the kinds of a plot; emits `complete` once all are there, or `timed_out` with what is missing when its timer fires.

    One value of state per plot: the kinds seen so far, and whether the plot is
    complete. The timer is set by the first arrival's event time; it fires once
    the watermark has passed it, and takes the state with it. What arrives for
    the plot afterwards begins a new wait.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("seen", StringType()), StructField("wanted", StringType()), StructField("complete", BooleanType())]))

    def _row(self, key, state: str, missing: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"plot": [key[0]], "state": [state], "missing": [",".join(missing)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, first, wanted = self.state.get(), None, None
        seen, complete = (set(json.loads(held[0])), held[2]) if held else (set(), False)
        for frame in rows:
            seen.update(frame["kind"].dropna())
            wanted = frame["wanted"].iloc[0]
            began = int(frame["ms"].min())
            first = began if first is None else min(first, began)
        if held is None:
            self.handle.registerTimer(first + self.timeout_ms)
        if complete:
            return
        missing = [k for k in json.loads(wanted) if k not in seen]
        self.state.update((json.dumps(sorted(seen)), wanted, not missing))
        if not missing:
            yield self._row(key, "complete", [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.clear()
        if held and not held[2]:
            seen = set(json.loads(held[0]))
            yield self._row(key, "timed_out", [k for k in json.loads(held[1]) if k not in seen])

    def close(self) -> None:
        pass


def watch_completeness(arrivals: DataFrame, expected: DataFrame, ts: str, timeout_s: int = 10_800, delay: str = "1 minute") -> DataFrame:
    """(plot, state, missing) of a stream (plot, kind, ts, ...) in event time.

    `expected` (kind) lists the kinds that each plot needs; it is joined to the
    stream, so it may come from any table. Kinds of a plot may come in any order
    until its timer, `timeout_s` after its first arrival, is behind the
    watermark; rows behind the watermark are too late and dropped, and other
    kinds than the expected ones don't count. The session needs the RocksDB
    state store provider.
    """
    # one row: the list of kinds that each plot's state repeats
    wanted = expected.select("kind").where("kind is not null").distinct().agg(F.to_json(F.array_sort(F.collect_list("kind"))).alias("wanted"))
    stamped = arrivals.select(F.col("plot").cast("string").alias("plot"), F.col("kind").cast("string").alias("kind"), F.col(ts).cast("timestamp").alias("_at")).withWatermark("_at", delay)
    rows = stamped.crossJoin(F.broadcast(wanted)).withColumn("kind", F.when(F.array_contains(F.from_json("wanted", "array<string>"), F.col("kind")), F.col("kind"))).withColumn("ms", F.unix_millis("_at"))
    return rows.groupBy("plot").transformWithStateInPandas(Completeness(timeout_s * 1000), "plot string, state string, missing string", "Append", "EventTime")


def completeness_batch(arrivals: DataFrame, kinds: list[str]) -> DataFrame:
    """The state that `watch_completeness` reaches when all of a bounded stream has arrived."""
    wanted = F.array(*[F.lit(k) for k in sorted(kinds)])
    out = arrivals.where(F.col("kind").isin(kinds)).groupBy("plot").agg(F.collect_set("kind").alias("have"))
    missing = F.array_except(wanted, "have")
    return out.select("plot", F.when(F.size(missing) == 0, "complete").otherwise("timed_out").alias("state"), F.array_join(missing, ",").alias("missing"))


def progress(results: DataFrame, status: str = "status") -> DataFrame:
    """Running counts by status; written with output mode update."""
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def incremental_todo(scenes: DataFrame, keys: list[str], ts: str, delay: str = "3 hours") -> DataFrame:
    """Each key once within the watermark."""
    return scenes.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def arrivals_per_window(arrivals: DataFrame, ts: str, width: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Arrivals per tumbling interval; rows behind the watermark are dropped."""
    stamped = arrivals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return stamped.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
