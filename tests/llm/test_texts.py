"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import random
import struct
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import byte_bpe, language_id, licenses, line_dedup, mixing, ngram_join, suffix_dedup
from clickloom.llm.components import components
from clickloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, score double, ids int, _doc int"


def docs(spark, texts, lang=None):
    rows = [(i, t, lang[i] if lang else "en", 0.5, 7, 1) for i, t in texts] if texts and isinstance(texts[0], tuple) else [(i, t, lang[i] if lang else "en", 0.5, 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


# --- language ID


def test_language_id_learns_and_rejects(spark):
    french = [" ".join(random.Random(i).choices(["le", "chat", "mange", "dans", "maison", "avec", "où"], k=60)) for i in range(30)]
    german = [" ".join(random.Random(i).choices(["der", "Hund", "läuft", "über", "Straße", "nicht", "ich"], k=60)) for i in range(30)]
    known = docs(spark, french + german, ["fr"] * 30 + ["de"] * 30)
    dictionaries = language_id.train(known, learn=F.col("doc_id") % 5 != 0)
    assert set(dictionaries) == {"fr", "de"} and all(len(d) <= language_id.DICTIONARY_BYTES for d in dictionaries.values())
    odd = docs(spark, ["le chat mange dans la maison avec le chat", "DER HUND LÄUFT ÜBER STRASSE nicht", None, "", "12 :: 34", "x" * 300_000])
    got = {r["doc_id"]: r for r in language_id.classify(odd, dictionaries).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["fr", "de", "und", "und", "und"]
    assert got[0]["accepted"] and not got[2]["accepted"] and got[0]["ids"] == 7  # a clashing "score" is replaced, others stay
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.classify(odd.limit(0), dictionaries).count() == 0
    assert language_id.train(odd.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.classify(odd, {}).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    from clickloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    true = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op1_language_id"](spark, folder).join(true, "doc_id").where("held_out AND lang IS NOT NULL")
    total, right, kept = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("accepted").cast("int"))).first()
    assert right / total >= 0.95 and kept / total >= 0.97


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


def test_bpe_matches_library(vocab):
    import public_tokenizers as public
    import tiktoken

    ranks = {t: i for i, t in enumerate(vocab.tokens)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, r = byte_bpe.Encoder(vocab, cached_pieces=50, cached_pairs=50), random.Random(4)
    texts = ["", " ", "a" * 5_000, "été\n\n  naïve 日本語 \U0001f600 1234's", "<|endoftext|>", "ab" * 4_000]
    texts += ["".join(r.choice("abetino rn. 'é1\n日") for _ in range(r.randint(1, 40))) for _ in range(2_000)]
    for t in texts:
        want = library.encode_ordinary(t)
        assert encoder.encode(t) == struct.pack(f"<{len(want)}I", *want), t


def test_bpe_small_vocabulary_exhaustive(tmp_path):
    """Merges that overlap in all ways, against plain merging by rank."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"cab", b"aa", b"aab", b"bcab"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    v = byte_bpe.load(str(path), r"\S+")
    encoder, ranks = byte_bpe.Encoder(v), {t: i for i, t in enumerate(tokens)}

    def merge(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [bytes([x]) for x in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(1)
    for _ in range(3_000):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
        assert encoder.merge(piece) == merge(piece), piece


def test_bpe_round_trip(spark, vocab):
    d = docs(spark, ["Ein Text über nichts.", None, "", "Ein Text über nichts.", "z" * 100_000])
    out = byte_bpe.decode(byte_bpe.encode(d, vocab), vocab).collect()
    assert [bytes(r["decoded"]).decode() for r in out] == ["Ein Text über nichts.", "", "", "Ein Text über nichts.", "z" * 100_000]
    assert byte_bpe.encode(d.limit(0), vocab).count() == 0


# --- line dedup


def line_brute(rows):
    import re

    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or first.get(key(x), doc) >= doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fan_out", [(1, 4), (4, 2), (7, 2)])
def test_line_dedup(spark, batches, fan_out):
    r = random.Random(batches)
    lines = ["The same long line here", "  THE SAME long line here\t", "short", "", "élan vital toujours", "ÉLAN vital toujours", "another line of text", "trailing  "]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 6)))) for i in range(30)] + [(40, None), (41, ""), (None, "The same long line here"), (3, "The same long line here"), (50, "hot line number one\n" * 5_000)]
    got = line_dedup.dedup_lines(docs(spark, rows), batches=batches, fan_out=fan_out).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got), key=repr) == sorted(line_brute(rows), key=repr)
    assert got[0]["score"] == 0.5


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(docs(spark, ["x"]).limit(0)).count() == 0


# --- suffix-array dedup


def spans_brute(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, hot):
    passage = " ".join(words(1, 60))
    texts = [f"{' '.join(words(i, 30))} {passage[i:]} {' '.join(words(i + 99, 20))}" for i in range(12)]
    texts += [texts[3], None, "", "short", "a" * 500, "a" * 300 + "b", "é" * 200, " ".join(words(7, 2_000))]
    got = suffix_dedup.remove_repeats(docs(spark, texts), length=80, shard_bytes=4_000, hot_regions=hot)
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.orderBy("doc_id").collect()]
    assert got == spans_brute(texts, 80)


def test_suffix_dedup_repeated_and_null_ids(spark):
    text = " ".join(words(5, 60))
    got = suffix_dedup.remove_repeats(docs(spark, [(1, text), (1, text), (None, "x" + text), (None, "alone")]), length=80).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(text), len(text), len(text)]
    assert suffix_dedup.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def test_two_stage_order_and_prefixes():
    r = random.Random(6)
    for _ in range(60):
        regions = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(48, 90))) for _ in range(r.randint(1, 6))]
        regions += regions[:1]
        counts = np.array([len(x) - 40 + 1 for x in regions])
        masks = suffix_dedup.repeated_starts(regions, counts, np.zeros(len(regions), bool), 40)
        for x, n, mask in zip(regions, counts, masks):
            want = [sum(y.startswith(x[i : i + 40], j) for y, m in zip(regions, counts) for j in range(m)) > 1 for i in range(n)]
            assert mask.tolist() == want


# --- n-gram Jaccard join


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    named = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            named[find(i)] = min(doc, named.get(find(i), doc))
    return sorted(((doc, len(s), named.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_rows():
    rows, r = [], random.Random(9)
    for g in range(6):
        base = words(g, 60 + 40 * g)
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = f"x{r.randrange(50)}"
            rows.append(" ".join(w))
    chain = words(77, 100)
    rows += [" ".join([*chain[k:], *(f"c{k}_{i}" for i in range(k))]) for k in range(0, 40, 4)]
    rows += ["one two three", "One  two\tthree", "one two", None, "", " \n ", "a b c d e", "A b c d e", " ".join(words(3, 5_000)), "x"]
    return list(enumerate(rows))


@pytest.mark.parametrize("block,task", [(4_096, 50_000), (5, 20)])
def test_ngram_join(spark, monkeypatch, block, task):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", task)
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 4 if block == 5 else 500)
    rows = [*near_rows(), (None, "one two three"), (None, "nobody else says this at all"), (500, "a b c d e"), (500, "a b c d e")]
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == jaccard_brute(rows)


def test_ngram_join_frequent_pivots_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SAMPLE_REPEATS", 1)
    rows = near_rows()[:40]
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == jaccard_brute(rows)


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(61)) and got[101] == got[105] == 100 and 7 in got


# --- mixing


def test_mixing_meets_marginals(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice(["en", "fr"]), r.randrange(1, 50)) for i in range(600)] + [(999, "a", "en", 0), (None, "b", "fr", 5)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long").withColumn("weight", F.lit("x"))
    cells = mixing.cell_tokens(d, ["source", "lang"])
    targets = {"source": mixing.flattened(cells, "source", 0.0), "lang": mixing.flattened(cells, "lang", 0.0)}
    fit = mixing.rake(cells, targets, rounds=30).toPandas()
    assert np.allclose(fit.groupby("source", dropna=False).weight.sum(), 1 / 3, atol=1e-6)
    assert np.allclose(fit.groupby("lang").weight.sum(), 0.5, atol=1e-6)
    out = mixing.mix(d, ["source", "lang"], targets, 0.3).toPandas()
    assert len(out) == len(rows) and out.probability.between(0, 1).all()
    assert not out[out.tokens == 0].sampled.any()
    assert mixing.mix(d.limit(0), ["source", "lang"], targets, 0.3).count() == 0


def test_mixing_sample_meets_marginals_of_uneven_sources(spark):
    sizes = {("a", "en"): 6_000, ("a", "fr"): 1_500, ("b", "en"): 1_500, ("b", "fr"): 800, (None, "en"): 2_500, (None, "fr"): 200}
    rows = [(i, s, g, n // 10) for i, ((s, g), n) in enumerate((k, n) for k, n in sizes.items() for _ in range(10))]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long")
    cells = mixing.cell_tokens(d, ["source", "lang"])
    targets = {x: mixing.flattened(cells, x, 0.5) for x in ("source", "lang")}
    cut = mixing.mix(d, ["source", "lang"], targets, 0.6, calibrated=False)
    out = mixing.mix(d, ["source", "lang"], targets, 0.6)
    p = out.toPandas()
    assert p.probability.between(0, 1).all() and (p.probability == 1).any()
    assert abs((p.tokens * p.probability).sum() / (0.6 * p.tokens.sum()) - 1) < 1e-3
    share = mixing.marginals(out, targets).toPandas()
    assert len(share) == 5 and np.allclose(share.target, share.expected, atol=1e-3)
    missed = mixing.marginals(cut, targets).toPandas()
    assert not np.allclose(missed.target, missed.expected, atol=1e-3)
    all_of_it = mixing.mix(d, ["source", "lang"], targets, 1.0, rounds=3)
    left = mixing.marginals(all_of_it, targets).toPandas()
    assert (left.target - left.expected).abs().max() > 0.01  # a budget that cannot be met is told


# --- licenses


def test_license_scan_and_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/x.c", "code here"), ("a/b/y.c", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("a/b/c/z.c", None), ("d/w.c", ""), ("top", "prose the of and to"), (None, "Released under the MIT License."), ("a/x.c", "code here"), ("a/b/LICENSE", "Released under the GNU General Public License version 3.")]
    d = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("clash"))
    got = {r["path"]: (r["license"], r["how"], r["source_path"]) for r in licenses.scan_tree(d, file_words=9).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", "a/LICENSE") and got["a/x.c"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/y.c"] == ("Apache-2.0", "own", "a/b/y.c") and got["a/b/c/z.c"] == ("GPL-3.0", "inherited", "a/b/LICENSE")
    assert got["d/w.c"] == got["top"] == got[None] == (None, None, None)
    assert licenses.scan_tree(d.limit(0)).count() == 0


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
"""


@pytest.mark.parametrize("text,license", [
    (GPL_HEADER, "GPL-3.0"),
    ("dnl Licensed under the Apache License,\ndnl Version 2.0.\n", "Apache-2.0"),
    (licenses.TEMPLATES["MIT"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it", "MIT"),
    ("Released under the MIT License. Please send bug reports and further wishes to the list of the project.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("we use this file and the software under the rules of the shop, free of charge to any person", None),
])
def test_license_of_wrapped_and_long_notices(text, license):
    hit = licenses.matcher(licenses.TEMPLATES, licenses.MIN_COSINE)(text.encode())
    assert (hit and hit[0]) == license


def test_license_files_of_full_length(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Writer\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["MIT-text"], 70))
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n" + "further terms of the licence\n" * 40
    code = "\n".join(f"value{i} = call{i}(x{i})" for i in range(60))
    files = [("m/LICENSE", mit), ("m/x.py", "code"), ("n/17", mit), ("n/x.py", "code"), ("g/3", gpl), ("g/x.py", "code"), ("h/a.py", GPL_HEADER + code), ("h/x.py", "code"), ("c/COPYING.txt", "Notes of the project. " * 30 + "\n" + GPL_HEADER), ("c/x.py", "code")]
    got = {r["path"]: (r["license"], r["how"]) for r in licenses.scan_tree(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["m/LICENSE"] == got["n/17"] == ("MIT", "own") and got["m/x.py"] == got["n/x.py"] == ("MIT", "inherited")
    assert got["g/x.py"] == got["c/x.py"] == ("GPL-3.0", "inherited")
    assert got["h/a.py"] == ("GPL-3.0", "own") and got["h/x.py"] == (None, None)


def test_license_prefilter_is_exact():
    weights = licenses.template_weights()
    for c in (0.5, 0.8):
        telling = set(licenses.telling_terms(weights, c))
        for name in {w[0] for w in weights}:
            assert sum(w[3] ** 2 for w in weights if w[0] == name and w[2] not in telling) < c * c
