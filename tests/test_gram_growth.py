"""Character n-grams are counted inside their text."""

from __future__ import annotations

from collections import Counter

import pytest

from clickloom.operators import features


@pytest.mark.parametrize("low,high", [(1, 3), (2, 5)])
def test_grams_make_no_row_per_character(spark, low, high):
    rows = [(1, "banana\nbanana"), (2, "日本😀日本"), (2, "ab"), (3, ""), (4, None), (None, "x"), (None, "xy"), (5, "a")]
    out = features.char_ngrams(spark.createDataFrame(rows, "id long, text string"), "id", "text", low, high)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = Counter((i, t[p : p + n]) for i, t in rows if t for n in range(low, high + 1) for p in range(len(t) - n + 1))
    found = out.collect()
    assert {(r.id, r.gram): r.cnt for r in found} == dict(want) and len(found) == len(want)
