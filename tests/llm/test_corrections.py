"""Cases that earlier versions got wrong, and the pipeline's stages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import language_id, segment_search, vp_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SAMPLE = {
    "en": "the quick brown fox jumps over the lazy dog and runs through the old forest where the river bends ",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und laeuft durch den alten wald am fluss ",
}


def test_number_signs_are_no_letters(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² ①", "Ⅷ", "", None, "123 !?", "der hund"])], "doc_id long, text string")
    known = {lang: (text * 20).encode() for lang, text in SAMPLE.items()}
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in language_id.classify(rows, known).collect()}
    assert all(got[i] == ("und", 0.0, False) for i in range(5)) and got[5][0] == "de"


def test_copies_fill_no_dictionary(spark):
    rows = [(f"copied text number one {SAMPLE['en']}", "en")] * 500 + [(f"{SAMPLE['en']} {i} {'abcdefgh'[i % 8]} word{chr(97 + i % 26)}", "en") for i in range(50)]
    known = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert known["en"].count(b"copied text number one") == 1 and len(known["en"]) > 3_000


def test_short_texts_that_tie_are_kept(spark):
    """No size tells the language of a short foreign text; a long text of no known language may be rejected."""
    known = {lang: (text * 20).encode() for lang, text in SAMPLE.items()}
    rows = spark.createDataFrame([(1, "Hola amigo"), (2, "zq")], "doc_id long, text string")
    assert all(r.accepted and r.score == 0 for r in language_id.classify(rows, known).collect())


def brute(x, ids, queries, k):
    out = set()
    for q in queries:
        best = {}
        for i, v in zip(ids, x, strict=True):
            if i != ids[q]:
                best[i] = max(best.get(i, -math.inf), float((v * x[q]).sum()))
        out |= {(ids[q], n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k])}
    return out


@pytest.mark.parametrize("shard", [200, 8_192])
def test_ties_of_different_vectors_go_to_the_smaller_id(spark, shard):
    x = np.array([v for v in itertools.product((-1.0, 0.0, 1.0), repeat=6) if any(v)])
    order = np.random.default_rng(0).permutation(len(x))
    ids = [int(i) for i in order]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = [q for q in range(len(x)) if ids[q] % 40 == 0]
    want = brute(x, ids, asked, 20)
    for found in (
        vp_tree.nearest(rows, F.col("vec_id") % 40 == 0, 20, leaf=16, shard_rows=shard),
        segment_search.nearest(rows, F.col("vec_id") % 40 == 0, 20, shard_rows=shard),
    ):
        assert {(r.query_id, r.rank, r.vec_id) for r in found.collect()} == want


def test_an_id_with_many_near_vectors_takes_one_place(spark):
    r = np.random.default_rng(1)
    x = [[4.0 + i / 100, 0.0, float(i % 3)] for i in range(60)] + r.integers(-3, 4, size=(80, 3)).astype(float).tolist()
    ids = [500] * 60 + list(range(80))
    x[60] = [3.0, 1.0, 0.0]
    rows = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<double>")
    want = brute(np.array(x), ids, [60], 20)
    for found in (vp_tree.nearest(rows, F.col("vec_id") == 0, 20, leaf=8), segment_search.nearest(rows, F.col("vec_id") == 0, 20)):
        assert {(r.query_id, r.rank, r.vec_id) for r in found.collect()} == want


def odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base + " thirteen fourteen", "en", "a", 1), (2, base + " thirteen", "en", "a", 1), (3, base + " thirteen fourteen", "en", "b", 1),
        (5, "wholly other words about ships and sails on the sea", "en", "a", 1), (5, "nothing in common here with any other text at all", None, "a", 1), (5, "a third thing under this id says the old man", "en", None, 1),
        (None, base + " thirteen fourteen fifteen", "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0),
        (9, long, "en", "a", 1), (10, long + " more", "en", "b", 1), (11, "½ ²", "en", "a", 3), (12, "short", "en", "a", 5), (12, "short", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def test_one_document_of_each_group_stays(spark):
    docs = odd_documents(spark)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    group = {r: r for r in rows}
    for a, b in itertools.combinations(rows, 2):
        x, y = shingles(a[1]), shingles(b[1])
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            old, new = group[b], group[a]
            group = {r: new if g == old else g for r, g in group.items()}
    groups = {}
    for r, g in group.items():
        groups.setdefault(g, []).append(r)
    assert len(got) == len(groups)
    for members in groups.values():
        stay = got & set(members)
        assert len(stay) == 1 and next(iter(stay))[0] == members[0][0]


def test_lines_leave_as_in_brute_force(spark):
    rows = [(i, f"shared line of text\nown line {i}\n  Shared Line of TEXT \n\nshort", "en", "a", 0) for i in range(6)] + [(6, None, "en", "a", 0), (7, "", "en", "a", 0), (None, "shared line of text", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    want = {0: rows[0][1], **{i: f"own line {i}\n\nshort" for i in range(1, 6)}, 6: None, 7: ""}
    got = {r.doc_id: (r.text, r.n_lines, r.n_chars) for r in out.collect() if r.doc_id is not None}
    assert {i: (t or "") for i, (t, _, _) in got.items()} == {i: (t or "") for i, t in want.items()}
    assert all(n == "mine" for _, n, _ in got.values())


CLASH = ["lang_pred", "score", "accepted", "n_lines", "n_dropped", "weight", "probability", "sampled", "_topic", "_tokens", "_row", "body", "ids", "a.b"]


def test_further_columns_come_through_untouched(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASH})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, "clash")
        for r in docs.collect():
            assert all(r[c] == f"{c}:{r['doc_id']}" for c in CLASH)
    assert docs.count() > 0


def test_stages_run_on_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.written(stage(spark, docs, ""), "odd")
            assert out.columns == docs.columns and out.count() <= docs.count()
        tokens = corpus_pipeline.encode_tokens(spark, docs, "").collect()
        assert len(tokens) == docs.count() and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in tokens)


def test_encoding_is_checked_in_one_pass(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.encode_tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    import public_tokenizers as P
    import tiktoken
    from base64 import b64decode

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(hashlib.sha256(r.ids).hexdigest() for r in out.collect()) == sorted(digest(plain.encode_ordinary(r.text or "")) for r in docs.collect())
