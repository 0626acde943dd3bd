"""Preference pairs of queries that are all small: one join by query, and sums per row where the pairs are."""

from __future__ import annotations

import pytest

from clickloom.operators import training, trees

ROWS = [(q, i, (q + i) % 3, float(i)) for q in range(20) for i in range(5)] + [(None, 1, 1, 1.0), (7, None, 1, 2.0), (7, 1, None, 3.0), (7, 1, 2, 4.0)]
SCHEMA = "q long, id long, label int, score double"
KEY = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def rows(spark, frame):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "-1")
    yield frame(ROWS, SCHEMA)
    spark.conf.set(KEY, before)


def test_sums_per_row_need_no_further_shuffle(rows):
    plan = trees.pair_gradients(rows, "q", "id", "label", "score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Generate explode") == 1


def test_pairs_are_those_of_the_blocks(rows, spark):
    found = []
    for block in ("2000", "2"):
        spark.conf.set("spark.clickloom.pairBlock", block)
        found.append(sorted((tuple(r) for r in training.pairwise(rows, "q", "label", ["score"], "id").collect()), key=str))
    spark.conf.unset("spark.clickloom.pairBlock")
    want = sorted(((a[0], a[1], b[1], a[3] - b[3]) for a in ROWS for b in ROWS if a[0] is not None and a[0] == b[0] and None not in (a[2], b[2]) and a[2] > b[2]), key=str)
    assert found == [want, want]
