"""Memory of one block of vectors and one block of queries."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from clickloom.operators import vectors


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_a_block_takes_little_memory_and_is_exact(metric):
    x = np.random.default_rng(2).normal(size=(vectors.VECTOR_BLOCK, 32)).round(1)
    ids = np.arange(len(x))
    tracemalloc.start()
    q, v, s = vectors._best(x[: vectors.QUERY_BLOCK], ids[: vectors.QUERY_BLOCK], x, ids, 10, metric, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for i in (0, 50):
        away = {"l2": np.sqrt(((x - x[i]) ** 2).sum(1)), "dot": -(x @ x[i]), "cosine": -(x @ x[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])}[metric]
        best = sorted((round(float(a), 9), j) for j, a in enumerate(away) if j != i)[:10]
        assert v[q == i].tolist() == [j for _, j in best] and s[q == i] == pytest.approx([a for a, _ in best], abs=2e-9)


def test_vectors_without_a_score_hide_no_others():
    x = np.array([[1.0, 0.0], [np.nan, 0.0], [0.9, 0.0], [0.0, 1.0]])
    q, v, _ = vectors._best(x[:1], np.array([0]), x, np.arange(4), 2, "l2", True)
    assert v.tolist() == [2, 3]
