"""Blocks of queries reach the shards of vectors without a broadcast, and batches of queries keep what single ones keep."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clickloom.llm import blocks, segment_search


def test_sent_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK_BLOCKS", 2)
    r = np.random.default_rng(3)
    x = r.integers(-9, 10, size=(300, 8)).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = segment_search.nearest(rows, F.col("vec_id") % 5 == 0, 4, shard_rows=30, block_rows=8)
    got = {(g.query_id, g.rank, g.vec_id) for g in found.collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for q in range(0, 300, 5):
        best = sorted((-int(x[q] @ x[v]), v) for v in range(300) if v != q)[:4]
        assert {(q, i + 1, v) for i, (_, v) in enumerate(best)} <= got
    assert len(got) == 240


def test_batches_of_queries_keep_what_single_queries_keep():
    r = np.random.default_rng(4)
    x, q = r.integers(-300, 300, size=(500, 24)).astype(float), r.integers(-300, 300, size=(9, 24)).astype(float)
    x[50:60] = x[0]
    levels = [(segment_search.segments(q, n), segment_search.segments(x, n)) for n in segment_search.LEVELS]
    for k in (1, 6, 499, 600):
        both = segment_search.survivors_at_once(q, x, levels, ((q**2).sum(axis=1), (x**2).sum(axis=1)), k)
        for one, (rows, score) in zip(q, both, strict=True):
            exact = (x @ one).astype(np.int64)
            assert (score == exact[rows]).all()
            bar = np.sort(exact)[::-1][min(k, 500) - 1]
            assert set(np.flatnonzero(exact >= bar)) <= set(rows.tolist())
