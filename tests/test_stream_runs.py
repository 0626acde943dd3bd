"""Streams that keep rows instead of keys x windows give the windows that Spark's own window state gives."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.session import fresh_dir
from clickloom.streaming import sinks, windows

START = datetime(2024, 1, 1)
WEIGHTS = {"view": 1, "buy": 5}
SCHEMA = "u long, i long, a string, ts timestamp"
KEYS = ["u", "i"]
HOW = {"size": "1 hour", "slide": "10 minutes"}


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def folder(spark, frame):
    first = [(u, i, "buy" if (u + i) % 4 == 0 else "view", at(7 * (u + 3 * i) % 180)) for u in range(5) for i in range(8)]
    ties = [(9, i, "view", at(30)) for i in range(5)] + [(9, None, "view", at(31)), (None, 1, "buy", at(32)), (8, 1, None, at(33)), (8, 1, "view", None)]
    # The second batch is late for some windows of its rows only, and far from the first; the third is late for all.
    second = [(1, 2, "buy", at(100)), (1, 2, "buy", at(100)), (1, 3, "view", at(150)), (1, 3, "view", at(400))]
    third = [(2, 2, "buy", at(10)), (2, 2, "buy", at(371)), (2, 2, "view", at(405))]
    path = fresh_dir(spark, "stream-runs")
    for rows in (first + ties, second, third, [(99, 0, "view", at(9_000))], [(99, 0, "view", at(9_001))]):
        frame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_windows_are_those_of_the_state_store(spark, folder):
    native = windows.sliding_score(stream(spark, folder), "ts", KEYS, "a", WEIGHTS, **HOW).drop("w")
    want = spark.read.parquet(sinks.run_to_table(native, "append", "native"))
    kept = windows.sliding_score(stream(spark, folder), "ts", KEYS, "a", WEIGHTS, runs=True, **HOW)
    step = windows.closed_windows(fresh_dir(spark, "kept-rows"), KEYS, **HOW)
    got = spark.read.parquet(sinks.run_to_table(kept, "append", "kept", step=step)).select(want.columns)
    assert rows_of(got) == rows_of(want) and want.count() > 300


def test_top_n_is_that_of_the_state_store(spark, folder):
    found = []
    for runs in (False, True):
        scored = windows.sliding_score(stream(spark, folder), "ts", KEYS, "a", WEIGHTS, runs=runs, **HOW)
        out = fresh_dir(spark, "kept-top")
        sinks.start_window_top_n(scored if runs else scored.drop("w"), ["u"], "i", "score", 2, out, fresh_dir(spark, "kept-state"), **HOW).awaitTermination()
        found.append(rows_of(spark.read.parquet(out).select("window_end", "u", "i", "score", "rn")))
    assert found[0] == found[1] and found[0]


def test_state_does_not_grow_with_keys(spark, folder):
    kept = windows.sliding_score(stream(spark, folder), "ts", KEYS, "a", WEIGHTS, runs=True, **HOW)
    step = windows.closed_windows(fresh_dir(spark, "kept-rows"), KEYS, **HOW)
    seen = []
    sinks_out = fresh_dir(spark, "kept-out")
    q = sinks.process_then_commit(kept, lambda b, i: step(b, i).write.parquet(f"{sinks_out}/batch={i}"), fresh_dir(spark, "kept-state"), True)
    q.awaitTermination()
    seen = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert seen and max(seen) <= 24


def test_windows_of_broken_slides_are_refused(spark, folder):
    step = windows.closed_windows(fresh_dir(spark, "kept-rows"), KEYS, size="1 hour", slide="25 minutes")
    with pytest.raises(ValueError):
        step(spark.range(1), 0)
