"""Keyed list state with timers against the same windows in batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clickloom.session import fresh_dir
from clickloom.streaming import keyed_state, windows

WEIGHTS = {"view": 1, "buy": 5}


def test_timers_rank_whole_windows_and_empty_the_state(spark, frame):
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    first = [(u, i, "buy" if (u + i) % 4 == 0 else "view", at(7 * (u + 3 * i) % 180)) for u in range(5) for i in range(8)]
    tied = [(9, i, "view", at(30)) for i in range(5)]
    second = [(1, 2, "buy", at(250)), (1, 3, "view", at(251))]
    late = [(2, 2, "buy", at(10))]  # its windows closed with the second batch
    end = [(99, 0, "view", at(100_000))]
    folder = fresh_dir(spark, "timed-in")
    schema = "u long, i long, a string, ts timestamp"
    # One file per micro-batch, in this order.
    for rows in (first + tied, second, late, end):
        frame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    scored = windows.sliding_score(stream, "ts", ["u", "i"], "a", WEIGHTS, size="1 hour", slide="30 minutes")
    out, before = fresh_dir(spark, "timed-out"), spark.conf.get(keyed_state.PROVIDER, None)
    query = keyed_state.start_timed(keyed_state.timed_top_n(scored, ["u"], "i", "score", 3), out, fresh_dir(spark, "timed-state"))
    query.awaitTermination()
    assert spark.conf.get(keyed_state.PROVIDER, None) == before
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(F.unix_timestamp("window_end"), "u", "i", "score", "rn").collect())

    seen = frame(first + tied + second, schema)
    batch = windows.window_top_n(windows.sliding_score(seen, "ts", ["u", "i"], "a", WEIGHTS, size="1 hour", slide="30 minutes"), ["u"], "i", "score", 3)
    want = sorted(tuple(r) for r in batch.select(F.unix_timestamp("window_end"), "u", "i", "score", "rn").collect())
    assert got == want and len({r[0] for r in got}) >= 8
    states = {s["operatorName"]: s["numRowsTotal"] for s in query.lastProgress["stateOperators"]}
    timed = [n for name, n in states.items() if "transformwithstate" in name.lower()]
    assert timed == [0]
