"""Baskets are sent to their items in rounds when all of them together are too much, and a round's shuffles go with it."""

from __future__ import annotations

from clickloom.operators import recommend
from clickloom.plans.stage import written


def test_rounds_give_what_one_round_gives(spark, monkeypatch):
    rows = [(u, (u * 7 + k * k * 3) % 23) for u in range(40) for k in range(2 + u % 9)] + [(None, 1), (1, None)]
    frame = spark.createDataFrame(rows, "u long, i long")
    one = sorted((r.base_id, r.rec_id, round(r.similarity, 9), r.rn) for r in recommend.swing(frame, "u", "i", top_k=3).collect())
    monkeypatch.setattr(recommend, "ROUND_ITEMS", 300)
    monkeypatch.setattr(recommend, "written", lambda df, purpose, **k: names.append(purpose) or written(df, purpose, **k))
    names: list[str] = []
    many = sorted((r.base_id, r.rec_id, round(r.similarity, 9), r.rn) for r in recommend.swing(frame, "u", "i", top_k=3).collect())
    assert names.count("swing-round") > 2 and many == one and one


def test_shuffles_of_a_written_stage_are_dropped(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    out = written(spark.range(1000).repartition(3), "dropped", drop_shuffles=True)
    assert out.count() == 1000 and spark.conf.get(key) == before
