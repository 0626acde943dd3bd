"""Inverted lists, boosted trees and their contributions, calibration, panels and draws: against brute force and known values."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import attribution, calibration, recommend, training, trees, vectors


def shape(kind, n=3_000, dim=24):
    r = np.random.default_rng(3)
    plain, centres = r.normal(size=(n, dim)), r.normal(size=(30, dim)) * r.uniform(0.3, 3, (30, 1))
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    return {"gaussian": plain, "clustered": centres[np.arange(n) % 30] + 0.3 * plain, "mixed norms": unit * r.uniform(0.1, 5, (n, 1)), "low dimension": plain[:, :5] @ r.normal(size=(5, dim))}[kind]


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "mixed norms", "low dimension"])
def test_inverted_lists_find_most_neighbours(spark, kind):
    x = shape(kind)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = rows.where("id % 30 = 0")
    centres = vectors.coarse_centres(rows, 40)
    lists = vectors.inverted_lists(rows, centres).cache()
    exact = vectors.knn(asked, rows, 5)
    for probes, least in ((24, 0.9), (40, 1.0)):
        found = vectors.ivf_search(asked, lists, centres, 5, probes)
        assert vectors.recall_against(found, exact).agg(F.avg("recall")).first()[0] >= least
    # Every vector stands in one list once.
    assert lists.count() == len(x) == lists.select("id").distinct().count()


def test_knn_takes_any_id_and_skips_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    x = np.random.default_rng(1).integers(-2, 3, size=(60, 3)).astype(float)  # many equal distances
    data = [(f"v{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("long", [1.0] * 4)]
    rows = spark.createDataFrame(data, "id string, vec array<double>")
    got = {}
    for r in vectors.knn(rows, rows, 4, same_table=True).collect():
        got.setdefault(r.query_id, []).append((r.rn, r.id))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    for q in range(60):
        best = sorted((far[q, j], f"v{j:02d}") for j in range(60) if j != q)[:4]
        assert [i for _, i in sorted(got[f"v{q:02d}"])] == [i for _, i in best]
    assert "none" not in got and "long" not in got
    cosine = vectors.knn(rows.where("id = 'v01'"), rows, 3, "cosine").orderBy("rn").collect()
    assert cosine[0].score == pytest.approx(1.0)
    centres = rows.where("id IN ('v00', 'v10', 'v20')").withColumnRenamed("id", "centre")
    assert vectors.ivf_search(rows, vectors.inverted_lists(rows, centres), centres, 4, 3).count() == 240
    assert vectors.ivf_search(rows, vectors.inverted_lists(rows.limit(0), centres), centres, 4, 3).count() == 0


def test_a_list_with_most_vectors_is_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    rows = spark.range(400).select("id", F.array((F.col("id") % 7).cast("double"), F.when(F.col("id") < 20, 100.0).otherwise(0.0)).alias("vec"))
    centres = spark.createDataFrame([(1, [3.0, 0.0]), (2, [3.0, 100.0])], "centre long, vec array<double>")
    lists = vectors.inverted_lists(rows, centres)
    assert {r.centre: r.parts for r in lists.select("centre", "parts").distinct().collect()} == {1: 8, 2: 1}
    found = vectors.ivf_search(rows, lists, centres, 3, 2)
    exact = vectors.knn(rows, rows, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


MODEL = [
    (0, 1, "a", 0.5, None, 10.0), (0, 2, "b", 1.5, None, 6.0), (0, 3, "a", 2.5, None, 4.0), (0, 4, None, None, 1.0, 2.0), (0, 5, "c", 0.0, None, 4.0),
    (0, 6, None, None, -2.0, 1.0), (0, 7, None, None, 0.5, 3.0), (0, 10, None, None, 3.0, 1.0), (0, 11, None, None, -1.0, 3.0), (1, 1, None, None, 0.7, 5.0),
]


def expected(nodes, n, x, known):
    """The model's value when only some features are known: both children by cover where one is not."""
    _, _, feature, threshold, value, cover = nodes[n]
    if feature is None:
        return value
    if feature in known:
        return expected(nodes, 2 * n if x[feature] is None or x[feature] <= threshold else 2 * n + 1, x, known)
    return sum(nodes[c][5] / cover * expected(nodes, c, x, known) for c in (2 * n, 2 * n + 1))


def test_contributions_are_shapley_values(spark):
    model = spark.createDataFrame(MODEL, trees.MODEL)
    rows = [(i, a, b, c, 9.0) for i, (a, b, c) in enumerate([(a, b, c) for a in (0.0, 1.0, 3.0, None) for b in (1.0, 2.0) for c in (-1.0, 1.0, float("nan"))])]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {}
    for r in trees.tree_contributions(df, "id", model, ["a", "b", "c", "d"]).collect():
        got.setdefault(r.id, {})[r.feature] = r.contribution
    base, scores = trees.base_score(model), {r.id: r.s for r in df.select("id", trees.tree_score(model).alias("s")).collect()}
    by_tree = [{r[1]: r for r in MODEL if r[0] == t} for t in (0, 1)]
    for i, *values in rows:
        x = dict(zip("abcd", [math.inf if v is not None and math.isnan(v) else v for v in values], strict=True))
        want = dict.fromkeys("abcd", 0.0)
        for order in permutations("abcd"):
            for j, f in enumerate(order):
                for nodes in by_tree:
                    want[f] += (expected(nodes, 1, x, order[: j + 1]) - expected(nodes, 1, x, order[:j])) / 24
        assert got[i] == pytest.approx(want, abs=1e-12)
        assert base + sum(got[i].values()) == pytest.approx(scores[i], abs=1e-12)


@pytest.fixture
def ranked(spark):
    """Queries whose better row has a middling value: no line can order them."""
    r = np.random.default_rng(8)
    rows = []
    for q in range(150):
        for i in range(6):
            x, y = float(r.uniform(0, 1)), float(r.uniform(0, 1))
            rows.append((q, i, x, y, None if i == 5 and q % 9 == 0 else x, int(0.3 < x < 0.7) + int(y > 0.8)))
    return spark.createDataFrame(rows, "q long, i long, x double, y double, z double, label int")


def pair_accuracy(df, score):
    pairs = training.pairwise(df.withColumn("_s", score), "q", "label", ["_s"], "i")
    return pairs.agg(F.avg(F.when(F.col("_s") > 0, 1.0).when(F.col("_s") == 0, 0.5).otherwise(0.0))).first()[0]


def test_boosted_trees_order_what_a_line_cannot(ranked):
    train, test = ranked.where("q % 3 <> 0"), ranked.where("q % 3 = 0")
    model = trees.boost_pairwise(train, "q", "i", "label", ["x", "y"], rounds=6, depth=3, eta=0.5, bins=16)
    linear = training.pairwise_fit(training.pairwise(train, "q", "label", ["x", "y"], "i"), ["x", "y"])
    line = sum(F.lit(float(w)) * F.col(c) for w, c in zip(linear.coefficients.toArray(), ["x", "y"], strict=True))
    ours, theirs = pair_accuracy(test, trees.tree_score(model)), pair_accuracy(test, line)
    assert ours > 0.9 and ours > theirs + 0.1
    sums = trees.tree_contributions(test.withColumn("id", F.col("q") * 10 + F.col("i")), "id", model, ["x", "y"]).groupBy("id").agg(F.sum("contribution").alias("s"))
    both = test.select((F.col("q") * 10 + F.col("i")).alias("id"), trees.tree_score(model).alias("t")).join(sums, "id")
    assert both.agg(F.max(F.abs(F.col("s") + trees.base_score(model) - F.col("t")))).first()[0] < 1e-9


def test_boosted_trees_on_odd_tables(ranked):
    missing = trees.boost_pairwise(ranked, "q", "i", "label", ["z"], rounds=1, depth=2)
    assert missing.where("feature IS NOT NULL").count() >= 1
    for odd in (ranked.withColumn("label", F.lit(1)), ranked.where("q < 0")):
        model = trees.boost_pairwise(odd, "q", "i", "label", ["x"], rounds=2)
        assert [(r.node, r.value) for r in model.collect()] == [(1, 0.0)] * 2
    flat = trees.boost_pairwise(ranked.withColumn("x", F.lit(2.0)), "q", "i", "label", ["x"], rounds=1)
    assert flat.count() == 1


def test_pooling_gives_the_closest_rising_rates():
    r = np.random.default_rng(0)
    for _ in range(50):
        n = r.integers(1, 9, 12)
        p = np.minimum(n, r.integers(0, 9, 12))
        got = calibration.pooled(p, n)
        want = [max(min(p[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, 12)) for j in range(i + 1)) for i in range(12)]
        assert got == pytest.approx(want) and (np.diff(got) >= -1e-12).all()


def test_calibration_of_scores(spark):
    rows = spark.range(4000).select(((F.col("id") % 200) / 50 - 2).alias("s"), F.col("id"))
    # The true rate is half of what the curve of the score says.
    rows = rows.withColumn("hit", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < 0.5 / (1 + F.exp(-F.col("s")))).cast("int")).withColumn("class", F.lit("a"))
    table = calibration.calibration_table(rows, "s", "hit", ["class"])
    out = calibration.calibrated(rows, table, "s", ["class"])
    near = out.agg(F.avg(F.abs(F.col("probability") - 0.5 / (1 + F.exp(-F.col("s")))))).first()[0]
    raw = calibration.log_loss_by_class(out.withColumn("raw", 1 / (1 + F.exp(-F.col("s")))), "raw", "hit", ["class"]).first().logloss
    assert near < 0.05 and calibration.log_loss_by_class(out, "probability", "hit", ["class"]).first().logloss < raw
    unseen = spark.createDataFrame([(-50.0, "a"), (50.0, "a"), (None, "a"), (0.0, "other")], "s double, class string")
    rates = [r.probability for r in calibration.calibrated(unseen, table, "s", ["class"]).orderBy(F.col("class"), F.asc_nulls_first("s")).collect()]
    ends = [r.rate for r in table.orderBy("code").collect()]
    assert rates[0] is None and rates[1] == ends[0] and rates[2] == ends[-1] and rates[3] is None
    assert calibration.calibration_table(rows.where("id < 0"), "s", "hit", ["class"]).count() == 0


def test_calibrated_intents_on_held_out_rows(spark):
    words = {"car": "rent a car cheap van", "poi": "where is the museum park", "fun": "open the window light"}
    rows = []
    for i in range(240):
        label = ("car", "poi", "fun")[i % 3]
        parts = words[label].split()
        rows.append((i, " ".join(parts[(i // 3 + j) % len(parts)] for j in range(3)), label))
    rows += [(900, None, "car"), (901, "no label", None)]
    found, report = calibration.calibrated_intents(spark.createDataFrame(rows, "id long, text string, label string"), ["id"], "text", "label", folds=2, width=1 << 10)
    held = found.collect()
    assert 40 <= len(held) <= 110 and all(0 < r.probability <= 1 for r in held)
    assert sum(r.prediction == r.label for r in held) / len(held) > 0.9
    assert {r["class"] for r in report.collect()} == {"car", "poi", "fun"} and sum(r.support for r in report.collect()) == len(held)


@pytest.mark.parametrize("n,low,high", [(65, 0.1, 0.3), (500, -0.5, -0.5), (500, -0.9, 2.0), (2000, -0.05, 0.1), (1000, -0.5, 0.9)])
def test_large_groups_get_exact_shares(spark, n, low, high):
    """Against the same integral over many more panels."""
    gains = np.linspace(low, high, n).round(6).tolist()
    df = spark.createDataFrame([("big", i, g) for i, g in enumerate(gains)] + [("small", 0, 0.5), ("small", 1, 0.2)], "g string, p long, x double")
    got = {(r.g, r.p): r for r in attribution.shapley(df, ["g"], "p", "x").collect()}
    assert len(got) == n + 2 and got["small", 0].shapley == pytest.approx(0.5 * (1 + 0.2 / 2))
    t, w = np.polynomial.legendre.leggauss(24)
    cuts = np.linspace(0, 1, 4 * n + 1)
    spots = (cuts[:-1, None] + (t + 1) / 2 * np.diff(cuts)[:, None]).ravel()
    weights = (w / 2 * np.diff(cuts)[:, None]).ravel()
    x = np.array(gains)
    logs = np.zeros(len(spots))
    for v in x:
        logs += np.log1p(spots * v)
    top = max(0.0, float(np.log1p(x).sum()))
    for i in (0, n // 3, n - 1):
        scaled = float((weights * np.exp(logs - top - np.log1p(spots * x[i]))).sum()) * x[i]
        share = scaled / (math.exp(float(np.log1p(x).sum()) - top) - math.exp(-top))
        assert got["big", i].share == pytest.approx(share, rel=1e-9, abs=1e-300)
    assert sum(r.share for (g, _), r in got.items() if g == "big") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("a,b", [(1.0, 1.0), (3.0, 7.0), (40.0, 2.0), (0.4, 0.7), (500.0, 900.0)])
def test_draws_have_the_moments_of_their_posterior(spark, a, b):
    keys = (F.col("id"),)
    x, y = recommend.gamma_draw(F.lit(a), "1x", *keys), recommend.gamma_draw(F.lit(b), "1y", *keys)
    drawn = spark.range(20_000).select(x.alias("x"), y.alias("y")).select((F.col("x") / (F.col("x") + F.col("y"))).alias("d"))
    mean, variance, lowest, highest, known = drawn.agg(F.avg("d"), F.var_samp("d"), F.min("d"), F.max("d"), F.count("d")).first()
    want = a * b / ((a + b) ** 2 * (a + b + 1))
    assert known == 20_000 and 0 <= lowest < highest <= 1
    assert mean == pytest.approx(a / (a + b), abs=4 * math.sqrt(want / 20_000)) and variance == pytest.approx(want, rel=0.08)
