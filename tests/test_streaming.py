"""Streams that are driven to their end over small files."""

import pytest
from pyspark.sql import functions as F

from plotweave.streaming import arrivals as T

SCHEMA = "plot string, kind string, ts timestamp"


def _source(spark, folder, rows):
    spark.createDataFrame(rows, "plot string, kind string, s string").select("plot", "kind", F.to_timestamp("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def _run(df, folder, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


ROWS = [("p1", "rad", "2024-01-01 00:00:01"), ("p1", "vis", "2024-01-01 00:00:07"), ("p2", "rad", "2024-01-01 00:00:08"), ("p1", "rad", "2024-01-01 00:00:09"), ("p1", "extra", "2024-01-01 00:00:16")]


@pytest.fixture()
def stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    _source(spark, folder, ROWS)
    return spark.readStream.schema(SCHEMA).parquet(folder), str(tmp_path / "state")


def test_progress(stream):
    got = _run(T.progress(stream[0].withColumnRenamed("kind", "status")), stream[1], "progress", "update")
    assert {(r.status, r.n) for r in got} == {("rad", 3), ("vis", 1), ("extra", 1)}


def test_todo_once(stream):
    got = _run(T.incremental_todo(stream[0], ["plot", "kind"], "ts"), stream[1], "todo")
    assert sorted((r.plot, r.kind) for r in got) == [("p1", "extra"), ("p1", "rad"), ("p1", "vis"), ("p2", "rad")]


def test_windows(stream):
    got = _run(T.arrivals_per_window(stream[0], "ts"), stream[1], "windows", "update")
    assert sorted(r.n for r in got) == [1, 4]


def test_completeness_batch(spark):
    df = spark.createDataFrame([(p, k) for p, k, _ in ROWS], "plot string, kind string")
    got = {r.plot: (r.state, r.missing) for r in T.completeness_batch(df, ["rad", "vis"]).collect()}
    assert got == {"p1": ("complete", ""), "p2": ("timed_out", "vis")}


def _wait(spark, tmp_path, *parts, timeout_s=60, delay="10 seconds", kinds=("rad", "vis")):
    """Rows that the watch gives after each part of the arrivals."""
    folder, out = str(tmp_path / "in"), []
    expected = spark.createDataFrame([(k,) for k in kinds], "kind string")
    for i, rows in enumerate(parts):
        _source(spark, folder, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        q = T.watch_completeness(stream, expected, "ts", timeout_s, delay).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        out.append(sorted((r.plot, r.state, r.missing) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    return out


def test_late_kinds_complete_a_plot_and_others_come_too_late(spark, tmp_path):
    at = lambda plot, kind, s: (plot, kind, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}")
    got = _wait(
        spark, tmp_path,
        [at("a", "rad", 0), at("b", "rad", 5), at("c", "rad", 6), at("c", "vis", 7), at("c", "vis", 8), at("d", "other", 1)],
        # b's second kind is late, out of order, but before its timer and the watermark (0:47 here)
        [at("z", "rad", 57), at("b", "vis", 50)],
        # the watermark goes to 3:10: the timers of a, d and z are behind it
        [at("y", "rad", 200)],
        # a's second kind is behind the watermark
        [at("a", "vis", 30), at("y", "vis", 201)],
    )
    assert got[0] == [("c", "complete", "")]
    assert got[1] == [("b", "complete", ""), ("c", "complete", "")]
    timed = [("a", "timed_out", "vis"), ("d", "timed_out", "rad,vis"), ("z", "timed_out", "vis")]
    assert got[2] == sorted([*got[1], *timed])
    assert got[3] == sorted([*got[2], ("y", "complete", "")])


def test_no_kinds_expected(spark, tmp_path):
    assert _wait(spark, tmp_path, ROWS, kinds=()) == [[("p1", "complete", ""), ("p2", "complete", "")]]
