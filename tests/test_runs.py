"""Sliding scores as runs of windows: nothing grows with size / slide before the windows are opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.streaming import windows

ROWS = [("a", 1, "x", 0), ("a", 1, "y", 7), ("a", 2, "x", 8), ("a", None, "x", 31), ("a", 2, "z", 45), ("b", 1, "y", 59), (None, 3, "y", 60), ("a", 1, "x", 180), ("a", 1, "x", 180)]


def scored(spark, **how):
    rows = spark.createDataFrame(ROWS, "u string, i long, a string, m long").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    return windows.sliding_score(rows, "ts", ["u", "i"], "a", {"x": 0.1, "y": 0.7}, size="1 hour", slide="10 minutes", **how)


def expected():
    cells = {}
    for u, i, a, m in ROWS:
        for end in range(m // 10 * 10 + 10, m // 10 * 10 + 61, 10):
            cells[end, u, i] = cells.get((end, u, i), 0) + {"x": 0.1, "y": 0.7}.get(a, 0)
    return cells


def minutes(df):
    return df.withColumn("window_end", (F.unix_seconds("window_end") / 60).cast("int")).collect()


def test_windows_are_opened_without_an_aggregate_over_them(spark):
    out = scored(spark)
    assert "Aggregate [window_end" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.window_end, r.u, r.i): r.score for r in minutes(out)} == pytest.approx(expected())
    assert out.count() == len(expected())


def test_top_n_of_runs_is_that_of_windows(spark):
    runs = scored(spark, runs=True)
    assert runs.count() < len(expected()) / 2
    best = windows.window_top_n(runs, ["u"], "i", "score", 2, size="1 hour", slide="10 minutes")
    plain = windows.window_top_n(scored(spark), ["u"], "i", "score", 2)
    key = lambda r: (r.window_end, r.u, r.rn, r.i, round(r.score, 9))
    assert sorted(map(key, minutes(best)), key=str) == sorted(map(key, minutes(plain)), key=str)
