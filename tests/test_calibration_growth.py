"""Grams of a text are made and hashed once for all fits and scores of the calibrated classifier."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF

from clickloom.operators import calibration


def test_grams_are_hashed_once(spark, monkeypatch):
    calls = []
    hashed = HashingTF.transform
    monkeypatch.setattr(HashingTF, "transform", lambda self, *a: calls.append(1) or hashed(self, *a))
    rows = [(i, f"{'ask' if i % 3 else 'tell'} {i} {'why' if i % 3 else 'so'}", "user" if i % 3 else "system") for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, text string, role string")
    predictions, report = calibration.calibrated_intents(frame, ["id"], "text", "role", folds=2, iters=3, width=1 << 8)
    assert len(calls) == 1
    got = predictions.collect()
    assert got and {r["prediction"] == r["role"] for r in got} == {True}
    assert sum(r["support"] for r in report.collect()) == len(got)
