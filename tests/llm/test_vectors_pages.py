"""Vector searches, archives, the registered SQL and the pipeline."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import clickloom.catalog.compare as comparison
import corpus_pipeline
from clickloom.llm import queries, segment_search, vp_tree, warc
from clickloom.session import fresh_dir

V = "vec_id long, embedding array<float>, score int, rank int"


def vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], 1, 1) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1, 1) for i in range(40)]  # ties
    rows += [(400, None, 1, 1), (401, [0.0] * 8, 1, 1), (402, [math.nan] * 8, 1, 1), (403, [None] + [1.0] * 7, 1, 1), (404, [math.inf] * 8, 1, 1), (405, [1.0] * 3, 1, 1), (None, [1.0] * 8, 1, 1), rows[5], (420, [], 1, 1)]
    return spark.createDataFrame(rows, V), [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute(rows, k, every, turn, zeros):
    rows = [(i, turn(np.array(v, np.float32).astype(float))) for i, v in rows]
    rows = [(i, v) for i, v in rows if zeros or v.any()]
    out = set()
    for q, x in rows:
        if q % every == 0:
            best = {}
            for i, v in rows:
                if i != q and len(v) == len(x):
                    best[i] = max(best.get(i, -math.inf), float((v * x).sum()))
            out |= {(q, n + 1, i, round(s, 9)) for n, (i, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k])}
    return out


@pytest.mark.parametrize("shard,block", [(8_192, 512), (40, 7)])
def test_vp_tree_factor_one_is_exact(spark, shard, block):
    d, rows = vectors(spark)
    got = vp_tree.nearest(d, F.col("vec_id") % 10 == 0, 6, factor=1.0, leaf=8, shard_rows=shard, block_rows=block).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute(rows, 6, 10, lambda v: v, False)


def test_vp_tree_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    got = {(r["query_id"], r["vec_id"]) for r in queries.QUERIES["op2_vp_tree"](spark, folder).collect()}
    want = {(int(q), int(ids[j])) for i, q in enumerate(ids) if q % 20 == 0 for j in [j for j in np.argsort(-(x @ x[i])) if j != i][:20]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def spread(kind):
    """4,096 vectors of 32 dimensions on which a bound that leaves out too much loses neighbours."""
    r = np.random.default_rng(3)
    plain, centres = r.normal(size=(4_096, 32)), r.normal(size=(40, 32)) * r.uniform(0.3, 3, (40, 1))
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    return {"gaussian": plain, "clustered": centres[np.arange(4_096) % 40] + 0.3 * plain, "mixed norms": unit * r.uniform(0.1, 5, (4_096, 1)), "low dimension": plain[:, :6] @ r.normal(size=(6, 32))}[kind]


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "mixed norms", "low dimension"])
def test_vp_tree_recall_on_uneven_vectors_over_shards(spark, kind):
    x = spread(kind)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in vp_tree.nearest(d, F.col("vec_id") % 20 == 0, 20, shard_rows=1_024).collect()}
    want = {(q, int(j)) for q in range(0, len(x), 20) for j in [j for j in np.argsort(-(x @ x[q])) if j != q][:20]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("shard,block", [(8_192, 512), (40, 7)])
def test_segment_search(spark, shard, block):
    d, rows = vectors(spark)
    whole = d.withColumn("embedding", segment_search.integers(F.col("embedding")))
    got = segment_search.nearest(whole, F.col("vec_id") % 10 == 0, 5, shard_rows=shard, block_rows=block).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], float(r["score"])) for r in got} == brute(rows, 5, 10, lambda v: np.floor(256 * v), True)


def test_searches_on_empty_tables(spark):
    d = vectors(spark)[0].limit(0)
    assert vp_tree.nearest(d, F.col("vec_id") % 10 == 0, 5).count() == 0
    assert segment_search.nearest(d, F.col("vec_id") % 10 == 0, 5).count() == 0


def test_large_integers_are_exact():
    q, x = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [2.0**40, -1.0]])
    assert segment_search.products(q, x).tolist() == [2**60 + 3, 2**63 - 1]


PAGES = [(1, "http://a/x y\nz", "<p>eins</p>"), (2, None, "<p>eins</p>"), (3, "u", None), (4, "u", ""), (5, "é", "zwei\r\n\r\nWARC/1.1 " * 400), (5, "é", "zwei\r\n\r\nWARC/1.1 " * 400), (None, "n", "<p>eins</p>"), (None, "n", "allein"), (9, "v", "z" * 200_000)]


@pytest.mark.parametrize("archive,span", [(2**26, 2**23), (50, 300)])
def test_warc_round_trip(spark, archive, span):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = fresh_dir(spark, "warc-test")
    plan = warc.plan_records(pages)
    index = warc.write_archives(plan, folder, archive_bytes=archive)
    back = warc.read_records(index, folder, range_bytes=span, gap_bytes=10).collect()
    assert len(back) == len(PAGES) == index.count()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in back if r["record_type"] == "response" and r["page_id"]) == [(2, "<p>eins</p>"), (4, ""), (5, PAGES[4][2]), (5, PAGES[4][2]), (9, "z" * 200_000)]
    assert {(r["page_id"], r["refers_to"]) for r in back if r["record_type"] == "revisit"} == {(1, 2), (3, 4), (None, 2)}
    few = warc.read_records(index.where("page_id IN (2, 9)"), folder, range_bytes=span).collect()
    assert sorted(r["page_id"] for r in few) == [2, 9]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_small_payloads_stay(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.archive_and_read(pages, min_bytes=100).collect()} == {"response"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_sql(spark, monkeypatch, name):
    monkeypatch.setattr(comparison, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(comparison, "ORACLES", queries.ORACLES)
    ok, message, _ = comparison.compare(spark, "/root/testdata/sf0.001", name)
    assert ok, message


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n", F.lit("extra"))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, folder), "test")
        assert out.columns == docs.columns, name
        assert out.count() == out.select("doc_id").distinct().count()
        docs = out
        sizes.append(docs.count())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.where("NOT round_trip").count() == 0 and out.count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] >= 0.95 * sizes[0]
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]
