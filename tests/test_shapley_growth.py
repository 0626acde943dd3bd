"""Small groups are summed as lists: no aggregate has a column per node."""

from __future__ import annotations

import math

import pytest

from clickloom.operators import attribution


def test_small_groups_have_no_wide_sums(spark):
    rows = [("g", 1, 0.5), ("g", 2, 0.2), ("g", 3, None), ("h", 1, 0.0), (None, 1, 0.3), ("n", 1, None)]
    out = attribution.shapley(spark.createDataFrame(rows, "g string, p long, x double"), ["g"], "p", "x")
    assert "sum(log1p" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r.g, r.p): (r.x, r.shapley, r.share) for r in out.collect()}
    assert len(got) == 5 and got["g", 1][1] == pytest.approx(0.55) and got["g", 2][2] == pytest.approx(0.25 / 0.8)
    assert got["g", 3] == got["n", 1] == (None, None, None) and got["h", 1] == (0.0, 0.0, None) and not math.isnan(got["g", 1][2])
