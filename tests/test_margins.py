"""Margins are computed from weights alone; no fitted model goes to the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import HashingTF

from clickloom.operators import calibration


def test_margins_from_weights(spark):
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=8)
    weights, intercepts = np.arange(16.0).reshape(2, 8), np.array([0.5, -1.0])
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["c"])], "id long, grams array<string>")
    got = {(r.id, r["class"]): (r.place, r.score) for r in calibration.class_scores((hashing, weights, intercepts), rows, ["p", "q"], ["id"]).collect()}
    at = [hashing.indexOf(g) for g in "abc"]
    assert got[1, "p"] == (0, 2 * at[0] + at[1] + 0.5) and got[1, "q"] == (1, 2 * (8 + at[0]) + 8 + at[1] - 1.0)
    assert got[2, "p"] == (0, 0.5) and got[2, "q"] == (1, -1.0) and got[3, "p"] == (0, at[2] + 0.5)
