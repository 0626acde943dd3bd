"""Grams of a text are made once for the intent classifier."""

from __future__ import annotations

from clickloom.catalog.registry import QUERIES
from clickloom.operators import search


def test_fitting_and_scoring_read_the_same_written_features(spark, tmp_path):
    rows = [(i, 0, f"{'ask' if i % 3 else 'tell'} {i} {'why' if i % 3 else 'so'}", "user" if i % 3 else "system") for i in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    features = search.intent_features(frame, "text")
    by_features = search.intent_fit(features, "text", "role").transform(features).select("conv_id", "prediction")
    by_text = search.intent_fit(frame, "text", "role").transform(search.with_grams(frame, "text")).select("conv_id", "prediction")
    assert sorted(by_features.collect()) == sorted(by_text.collect())
    out = QUERIES["tx7_intent_classifier"](spark, str(tmp_path))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.cnt for r in out.collect()) == 60
