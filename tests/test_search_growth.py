"""Work and layout of nearest-neighbour search as the vectors grow."""

from __future__ import annotations

import re

import numpy as np
import pytest

from clickloom.operators import vectors


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")


def test_files_of_inverted_lists_do_not_grow_with_the_centres(spark):
    x = np.random.default_rng(3).normal(size=(400, 6)).astype("f4")
    v = rows(spark, x)
    lists = vectors.inverted_lists(v, v.where("id % 4 = 0").withColumnRenamed("id", "centre"))
    assert lists.count() == 400 and lists.select("centre").distinct().count() > 50
    assert len(lists.inputFiles()) <= 4  # as many as shuffle partitions


def test_a_search_repeats_queries_by_the_memory_of_a_task(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 6)).astype("f4")
    v = rows(spark, x)
    want = vectors.knn(v, v, 5).collect()
    seen = []
    whole = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda q, *rest, **more: seen.append(q.count()) or whole(q, *rest, **more))
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(vectors, "HELD_BYTES", 8 * 6 * 100)
    got = vectors.knn(v, v, 5).collect()
    # 30 blocks of 10 would send every query to 30 places; a task holds 100, and cores ask for a few more.
    assert sorted(got) == sorted(want) and seen[0] <= 300 * 6


def test_hash_buckets_larger_than_a_task_meet_part_by_part(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(240, 5)).round(1).astype("f4")
    v = rows(spark, x)
    want = sorted(vectors.knn_lsh(v, v, 4, width=3.0, tables=3).collect())
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 20)
    monkeypatch.setattr(vectors, "HELD_BYTES", 0)
    found = vectors.knn_lsh(v, v, 4, width=3.0, tables=3)
    assert sorted(found.collect()) == want
    # Found pairs are dealt by their query once: no second exchange makes them one or ranks them.
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(query_id", plan)) <= 1


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
@pytest.mark.parametrize("case", ["near copies", "large", "odd"])
def test_single_precision_loses_no_neighbour(metric, case):
    r = np.random.default_rng(6)
    x = r.normal(size=(3_000, 8)).astype("f4")
    if case == "near copies":
        x = x[r.integers(0, 20, len(x))] + r.integers(0, 3, x.shape).astype("f4") * np.float32(1e-5)
    elif case == "large":
        x = x * np.float32(1e17)
    else:
        x[3, 1], x[4, 2], x[5] = np.nan, np.inf, 0
    ids = r.permutation(len(x))
    with np.errstate(all="ignore"):
        q, v, s = vectors._best(x[:40], ids[:40], x, ids, 6, metric, True)
        wide = x.astype("f8")
        fine = np.isfinite(wide).all(axis=1)
        for i in range(40):
            a = {"l2": lambda: np.sqrt(((wide - wide[i]) ** 2).sum(1)), "dot": lambda: -(wide @ wide[i]), "cosine": lambda: -(wide @ wide[i]) / np.linalg.norm(wide, axis=1) / np.linalg.norm(wide[i])}[metric]()
            a[~fine] = np.nan
            best = sorted((round(float(d), 9), j) for d, j in zip(a, ids.tolist(), strict=True) if np.isfinite(d) and j != ids[i])[:6]
            got = list(zip(s[q == ids[i]].tolist(), v[q == ids[i]].tolist(), strict=True))
            assert [d for d, _ in got] == pytest.approx([d for d, _ in best], rel=1e-12, abs=2e-9)
            if case != "near copies" and fine[i]:
                assert [j for _, j in got] == [j for _, j in best]
