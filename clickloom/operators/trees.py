"""Boosted trees on preference pairs, level by level from gradient histograms, and exact contributions of features to a tree model.

A model is a table (tree, node, feature, threshold, value, cover): the root is node 1, node n has the children 2n (feature at most
``threshold``, or missing) and 2n + 1, leaves have a value. It is as large as its parameters say (rounds x 2^depth), and only tables of
that size come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.training import pairwise
from clickloom.plans.ranks import exact_quantiles
from clickloom.plans.stage import written

MODEL = "tree int, node int, feature string, threshold double, value double, cover double"
DIGITS = 9


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins`` - 1 different cut points per feature: interpolated quantiles, rounded to 6 digits."""
    out = {}
    for f in features:
        names = [f"q{i}" for i in range(1, bins)]
        found = exact_quantiles(df.select(F.col(f).cast("double").alias("_x")), [], "_x", [i / bins for i in range(1, bins)], names).first()
        out[f] = sorted({round(v, 6) for v in (found or []) if v is not None})
    return out


def _bin(x: Column, cuts: Sequence[float]) -> Column:
    """How many cut points lie below; a missing value counts as the smallest."""
    return F.coalesce(F.size(F.filter(F.lit(list(cuts)), lambda c: c < x)), F.lit(0)) if cuts else F.lit(0)


def pair_gradients(scored: DataFrame, query: str, id: str, label: str, score: str) -> DataFrame:
    """(query, id, g, h): first and second derivatives of the pairwise logistic loss, summed over the row's pairs."""
    pairs = pairwise(scored, query, label, [score], id).withColumn("_p", 1 / (1 + F.exp(F.col(score))))
    side = lambda who, sign: F.struct(F.col(who).alias("id"), (sign * F.col("_p")).alias("g"), (F.col("_p") * (1 - F.col("_p"))).alias("h"))
    each = pairs.select(query, F.explode(F.array(side("better", -1.0), side("worse", 1.0))).alias("s")).select(query, "s.*")
    return each.groupBy(query, F.col("id").alias(id)).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best_splits(rows: DataFrame, n_cuts: Sequence[int], reg: float, min_child: float) -> list:
    """The best (feature, bin) of every node from one histogram pass; nodes without a gain are missing. At most 2^level rows."""
    cells = rows.select("node", "g", "h", F.posexplode(F.array(*[F.col(f"b{i}") for i in range(len(n_cuts))])).alias("f", "bin"))
    hist = cells.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    # Windows over the histogram: nodes x features x bins rows.
    along = Window.partitionBy("node", "f").orderBy("bin")
    whole = Window.partitionBy("node", "f")
    hist = hist.withColumns({"gl": F.sum("g").over(along), "hl": F.sum("h").over(along), "ga": F.sum("g").over(whole), "ha": F.sum("h").over(whole)})
    part = lambda g, h: g * g / (h + reg)
    gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
    gain = F.round((part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("ga"), F.col("ha"))) / 2, DIGITS)
    cut = F.col("bin") < F.get(F.lit(list(n_cuts)), F.col("f"))
    fine = hist.withColumn("gain", gain).where(cut & (F.col("hl") >= min_child) & (hr >= min_child) & (F.col("gain") > 0))
    return fine.groupBy("node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("best")).select("node", "best.*").collect()


def boost_pairwise(
    df: DataFrame, query: str, id: str, label: str, features: Sequence[str],
    rounds: int = 3, depth: int = 3, eta: float = 0.1, bins: int = 32, reg: float = 1.0, min_child: float = 1.0,
) -> DataFrame:
    """Trees that order the rows of a query by label: (tree, node, feature, threshold, value, cover).

    ``id`` names a row inside its query. Every round sums the pair gradients per row, then grows one tree with a histogram pass per
    level: rows meet only as sums per (node, feature, bin). A split needs ``min_child`` second derivatives on both sides and a
    gain above 0; ties go to the first feature and the smallest threshold. Cover is the sum of second derivatives. Queries with one
    label have no pairs; without any pairs the trees are single leaves of value 0.
    """
    cuts = quantile_cuts(df, features, bins)
    binned = {f"b{i}": _bin(F.col(f).cast("double"), cuts[f]) for i, f in enumerate(features)}
    rows = written(df.select(query, id, label, *[b.alias(n) for n, b in binned.items()], F.lit(0.0).alias("score")), "binned")
    model = []
    for tree in range(rounds):
        slopes = pair_gradients(rows.select(query, id, label, "score"), query, id, label, "score")
        at_root = written(rows.join(slopes, [query, id], "left").fillna(0.0, ["g", "h"]), "gradients")
        node, live, splits = F.lit(1), {1}, {}
        for _ in range(depth):
            here = at_root.withColumn("node", node).where(F.col("node").isin(sorted(live)))
            best = {r["node"]: (-r["f"], -r["bin"]) for r in _best_splits(here, [len(cuts[f]) for f in features], reg, min_child)}
            splits.update(best)
            old, node = node, None
            for n, (f, b) in best.items():
                step = F.when(F.col(f"b{f}") <= b, 2 * n).otherwise(2 * n + 1)
                node = F.when(old == n, step) if node is None else node.when(old == n, step)
            node = old if node is None else node.otherwise(old)
            live = {c for n in best for c in (2 * n, 2 * n + 1)}
            if not live:
                break
        # Sums of the leaves give those of all nodes above them.
        sums = {r["node"]: (r["g"], r["h"]) for r in at_root.groupBy(node.alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        value = {n: round(-eta * g / (h + reg), DIGITS) for n, (g, h) in sums.items()} or {1: 0.0}
        cover = {n: h for n, (_, h) in sums.items()} or {1: 0.0}
        for n in sorted(splits, reverse=True):
            cover[n] = cover.get(2 * n, 0.0) + cover.get(2 * n + 1, 0.0)
            f, b = splits[n]
            model.append((tree, n, features[f], float(cuts[features[f]][b]), None, float(cover[n])))
        model += [(tree, n, None, None, float(v), float(cover[n])) for n, v in value.items()]
        step = None
        for n, v in value.items():
            step = F.when(node == n, v) if step is None else step.when(node == n, v)
        rows = written(at_root.withColumn("score", F.col("score") + step).drop("g", "h"), "scored")
    return df.sparkSession.createDataFrame(sorted(model, key=lambda r: r[:2]), MODEL)


def _nodes(model: DataFrame) -> dict[int, dict[int, object]]:
    trees: dict[int, dict[int, object]] = {}
    for r in model.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    return trees


def tree_score(model: DataFrame) -> Column:
    """The sum of the trees' leaf values as one column expression."""

    def walk(nodes: dict, n: int) -> Column:
        r = nodes[n]
        if r["feature"] is None:
            return F.lit(float(r["value"]))
        x = F.col(f"`{r['feature']}`").cast("double")
        return F.when(x.isNull() | (x <= r["threshold"]), walk(nodes, 2 * n)).otherwise(walk(nodes, 2 * n + 1))

    return sum((walk(nodes, 1) for nodes in _nodes(model).values()), F.lit(0.0))


def leaf_paths(model: DataFrame) -> list[tuple[int, int, float, float, list[tuple[str, float | None, float | None, float]]]]:
    """(tree, leaf, value, share of the root's cover, conditions) of every leaf with a cover.

    Conditions on one feature are merged: (feature, above, at most, share), where share is the part of the cover that its splits
    let through.
    """
    out = []
    for tree, nodes in sorted(_nodes(model).items()):

        def walk(n: int, conds: dict, tree: int = tree, nodes: dict = nodes) -> None:
            r = nodes[n]
            if r["feature"] is None:
                whole = nodes[1]["cover"]
                out.append((tree, n, r["value"], r["cover"] / whole if whole else 1.0, [(f, *c) for f, c in conds.items()]))
                return
            for child in (2 * n, 2 * n + 1):
                if nodes[child]["cover"] > 0:
                    low, high, share = conds.get(r["feature"], (None, None, 1.0))
                    share *= nodes[child]["cover"] / r["cover"]
                    if child == 2 * n:
                        high = r["threshold"] if high is None else min(high, r["threshold"])
                    else:
                        low = r["threshold"] if low is None else max(low, r["threshold"])
                    walk(child, {**conds, r["feature"]: (low, high, share)})

        walk(1, {})
    return out


def tree_contributions(df: DataFrame, id: str, model: DataFrame, features: Sequence[str]) -> DataFrame:
    """(id, feature, contribution) for every feature: exact Shapley values of the model's score.

    A feature that is not known follows both children by their cover. The sum over a row's features and ``base_score`` is
    its ``tree_score``. For a leaf the average over all orders of its features is an integral over t from 0 to 1 of products of
    t x (condition holds) + (1 - t) x (share of the cover), a polynomial that Gauss-Legendre nodes integrate exactly; there is no list of
    subsets. All leaves of a row are worked on where the row is; only its sums per feature are shuffled.
    """
    paths = [(value, [(features.index(f), lo, hi, share) for f, lo, hi, share in conds]) for _, _, value, _, conds in leaf_paths(model) if conds]
    longest = max((len(c) for _, c in paths), default=1)
    nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-longest // 2)))
    spots = [(float((t + 1) / 2), float(w / 2)) for t, w in zip(nodes, weights, strict=True)]
    rows = df.select(F.col(id).alias("id"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
    zeros = rows.select("id", F.explode(F.lit(list(features))).alias("feature"), F.lit(0.0).alias("contribution"))
    if paths:
        conds_type = "array<struct<value: double, conds: array<struct<f: int, lo: double, hi: double, share: double>>>>"
        number = lambda v: "NULL" if v is None else f"{v!r}D"
        literal = ", ".join(
            f"struct({number(float(v))}, array({', '.join(f'struct({f}, {number(lo)}, {number(hi)}, {number(float(share))})' for f, lo, hi, share in conds)}))" for v, conds in paths
        )
        leaves = rows.withColumn("leaf", F.explode(F.expr(f"CAST(array({literal}) AS {conds_type})")))

        def holds(c: Column) -> Column:
            x = F.get(F.col("x"), c["f"])
            above = c["lo"].isNull() | F.coalesce(x > c["lo"], F.lit(False))
            return (above & (c["hi"].isNull() | x.isNull() | (x <= c["hi"]))).cast("double")

        at = lambda c, t: t * c["one"] + (1 - t) * c["share"]
        leaves = leaves.withColumn("factors", F.transform("leaf.conds", lambda c: F.struct(c["f"].alias("f"), holds(c).alias("one"), c["share"].alias("share"))))
        whole = lambda t: F.aggregate("factors", F.lit(1.0), lambda a, c: a * at(c, t))
        leaves = leaves.withColumns({f"p{m}": whole(t) for m, (t, _) in enumerate(spots)})
        rest = lambda c: sum((w * F.col(f"p{m}") / at(c, t) for m, (t, w) in enumerate(spots)), F.lit(0.0))
        cell = lambda c: F.struct(c["f"].alias("f"), (F.col("leaf.value") * (c["one"] - c["share"]) * rest(c)).alias("contribution"))
        moved = leaves.select("id", F.inline(F.transform("factors", cell)))
        moved = moved.select("id", F.get(F.lit(list(features)), "f").alias("feature"), "contribution")
        zeros = zeros.unionByName(moved)
    return zeros.groupBy("id", "feature").agg(F.sum("contribution").alias("contribution"))


def base_score(model: DataFrame) -> float:
    """The score of a row of which no feature is known."""
    return sum(value * share for _, _, value, share, _ in leaf_paths(model))
