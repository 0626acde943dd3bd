"""Sessions and item sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import stable_uniform
from clickloom.operators.relational import ITEMS_PER_ROW
from clickloom.plans.ranks import numbered, top_n
from clickloom.plans.scans import OrderedRows, following_row, previous_row, running_sum
from clickloom.plans.skew import salted_join, with_group
from clickloom.plans.stage import written


def sessionize(df: DataFrame, user: str, ts: str, gap: str = "30 minutes", tie: Sequence[str] = ()) -> DataFrame:
    """Add ``session`` (1, 2, ... per user): a new one starts iff the pause exceeds ``gap``."""
    rows = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    scan = OrderedRows(rows, [user], [ts, *tie]).add(_prev=previous_row(F.col(ts)))
    starts = F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > F.expr(f"interval {gap}"))
    scan = scan.add(session=running_sum(starts.cast("long")))
    return scan.rows().drop("_prev")


def session_positions(df: DataFrame, user: str, session: str, ts: str, item: str) -> DataFrame:
    """Distinct (ts, item) of each session with its position 1, 2, ..., one row each."""
    unique = df.select(user, session, ts, item).distinct()
    return numbered(unique, [user, session], [ts, item], "pos")


def session_sequences(
    df: DataFrame, user: str, session: str, ts: str, item: str, per_row: int = ITEMS_PER_ROW
) -> DataFrame:
    """Ordered item list per session; a list above ``per_row`` items continues in the next ``part``."""
    placed = session_positions(df, user, session, ts, item)
    part = F.floor((F.col("pos") - 1) / per_row).alias("part")
    pairs = F.sort_array(F.collect_list(F.struct("pos", F.col(item).alias("item"))))
    return placed.groupBy(user, session, part).agg(F.transform(pairs, lambda p: p["item"]).alias("items"))


def item_embeddings(
    seqs: DataFrame, items: str, dim: int = 50, min_count: int = 3, window: int = 3, iters: int = 10, seed: int = 1
) -> DataFrame:
    """Skip-gram item vectors (word, vector) learned from item sequences."""
    text = seqs.select(F.col(items).cast("array<string>").alias("items"))
    model = Word2Vec(
        vectorSize=dim, minCount=min_count, windowSize=window, maxIter=iters, seed=seed,
        inputCol="items", outputCol="vector", numPartitions=1 if iters == 1 else min(iters, 8),
    ).fit(text)
    return model.getVectors()


def skipgram_pairs(positions: DataFrame, keys: Sequence[str], item: str, m: int, pos: str = "pos") -> DataFrame:
    """Every (centre, context) at most ``m`` positions apart, from rows with a position.

    Each row is sent to the ``2 m`` positions around it and joined there by equality, so the output
    grows linearly and a long sequence is spread by position.
    """
    keys = list(keys)
    shifts = F.explode(F.array(*[F.lit(d) for d in range(-m, m + 1) if d]))
    context = positions.select(*keys, F.col(item).alias("context"), pos, shifts.alias("distance"))
    context = context.withColumn(pos, F.col(pos) + F.col("distance"))
    centre = positions.select(*keys, F.col(item).alias("centre"), pos)
    return centre.join(context, keys + [pos]).withColumn("distance", -F.col("distance"))


def negative_samples(pairs: DataFrame, freq: DataFrame, k: int, seed: int, power: float = 0.75) -> DataFrame:
    """``k`` noise items per (centre, context) pair, drawn in proportion to ``cnt ** power``.

    ``freq`` is (item, cnt). Draws and items meet in equal slices of the cumulative weight, so the range
    lookup is an equality join followed by a filter. A draw that hits the true context is moved to the
    next item.
    """
    # Whole-number weights, so that their sums do not depend on the order of the rows.
    weighted = freq.select("item", F.round(F.pow(F.col("cnt"), F.lit(power)) * 1_000_000).cast("long").alias("_w"))
    top = weighted.agg(
        F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_n"), F.min_by("item", F.struct(-F.col("_w"), "item")).alias("_first")
    )
    total, n_items, first = (top.select(c).scalar() for c in ("_total", "_n", "_first"))
    placed = OrderedRows(weighted, [], ["-_w", "item"]).add(
        _before=running_sum(F.col("_w"), inclusive=False), _next=following_row(F.col("item"))
    )
    placed = placed.add(_after=following_row(F.col("_before")))
    # As many slices as items: about one item per slice, heavy items cover several.
    table = placed.rows().withColumns({"_total": total, "_slices": n_items, "_first": first})
    table = table.select(
        "item",
        F.coalesce("_next", "_first").alias("_next"),
        (F.col("_before") / F.col("_total")).alias("_lo"),
        F.coalesce(F.col("_after") / F.col("_total"), F.lit(1.0)).alias("_hi"),
        "_slices",
    )
    table = table.withColumn(
        "_slice",
        F.explode(F.sequence(F.floor(F.col("_lo") * F.col("_slices")), F.floor(F.col("_hi") * F.col("_slices")))),
    ).drop("_slices")
    draws = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    draws = draws.withColumn("_u", stable_uniform(seed, *[F.col(c) for c in pairs.columns], F.col("draw")))
    draws = draws.withColumn("_slice", F.floor(F.col("_u") * n_items))
    hit = draws.join(table, "_slice").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    noise = F.when(F.col("item") == F.col("context"), F.col("_next")).otherwise(F.col("item"))
    out = hit.withColumn("negative", noise).where(F.col("negative") != F.col("context"))
    return out.select(*pairs.columns, "draw", "negative")


def pool_vectors(
    positions: DataFrame, user: str, item: str, vectors: DataFrame, how: str = "avg", weight: str | None = None
) -> DataFrame:
    """User vector pooled per dimension from the vectors (item, vector) of the user's items."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    seen = positions.groupBy(user, item).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_n"))
    joined = salted_join(seen, vectors.select(F.col(vectors.columns[0]).alias(item), "vector"), [item])
    dims = joined.select(user, "_w", "_n", F.posexplode("vector").alias("dim", "x"))
    x = F.col("x").cast("double")
    pooled = {
        "avg": F.sum(x * F.col("_n")) / F.sum("_n"),
        "max": F.max(x),
        "weighted": F.sum(x * F.col("_w")) / F.sum("_w"),
    }[how]
    by_dim = dims.groupBy(user, "dim").agg(pooled.alias("x"))
    return by_dim.groupBy(user).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector")
    )


def random_walks(edges: DataFrame, length: int, walks: int, seed: int) -> DataFrame:
    """``walks`` walks of ``length`` items from every node of a weighted item graph (src, dst, weight).

    A node's edges cover [0, 1) in proportion to their weights, cut into as many slices as it has edges.
    A step is one equality join of (node, slice of the draw) followed by a filter; the edge table already
    knows the degree of the next node. Walks at a much visited node spread over its slices.
    """
    edges = written(edges.select("src", "dst", "weight"), "walk-edges")
    total = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    cum = OrderedRows(edges, ["src"], ["dst"]).add(_before=running_sum(F.col("weight"), inclusive=False))
    cum = cum.add(_after=following_row(F.col("_before"))).rows()
    table = with_group(cum, ["src"], _total=F.sum("weight"), _deg=F.count(F.lit(1))).select(
        "src", "dst", "_deg",
        (F.col("_before") / F.col("_total")).alias("_lo"),
        F.coalesce(F.col("_after") / F.col("_total"), F.lit(1.0)).alias("_hi"),
    )
    table = salted_join(table, total.select(F.col("src").alias("dst"), F.col("_deg").alias("_next_deg")), ["dst"], "left")
    slot = lambda x: F.floor(x * F.col("_deg"))
    table = table.withColumn("_slice", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))))
    # Every step reads the table again.
    table = table.select("src", "_slice", "dst", "_lo", "_hi", F.coalesce("_next_deg", F.lit(0)).alias("_next_deg"))
    table = written(table, "walks")
    walk = total.select(
        F.col("src").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), "src", "_deg"
    ).withColumn("path", F.array("start"))
    for step in range(1, length):
        here = walk.withColumn("_u", stable_uniform(seed, F.col("start"), F.col("walk"), F.lit(step)))
        here = here.withColumn("_slice", F.floor(F.col("_u") * F.col("_deg"))).drop("_deg")
        met = here.join(table, ["src", "_slice"], "left")
        stuck = F.col("dst").isNull()
        met = met.where(stuck | ((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))))
        walk = met.select(
            "start", "walk",
            F.coalesce("dst", "src").alias("src"),
            F.coalesce("_next_deg", F.lit(0)).alias("_deg"),
            F.when(stuck, F.col("path")).otherwise(F.array_append("path", F.col("dst"))).alias("path"),
        )
    return walk.select("start", "walk", "path")


def change_points(df: DataFrame, by: Sequence[str], pos: str, value: str, k: int | Column) -> DataFrame:
    """The ``k`` rows per series that differ most from the row before, in series order.

    ``k`` may be a column of the series (for example a fifth of its length); ties go to the earlier row.
    """
    diffs = OrderedRows(df, by, [pos]).add(_prev=previous_row(F.col(value))).rows()
    diffs = diffs.withColumn("diff", F.abs(F.col(value) - F.col("_prev"))).where(F.col("diff").isNotNull())
    if isinstance(k, int):
        return top_n(diffs, by, ["-diff", pos], k).drop("_prev")
    return numbered(diffs, by, ["-diff", pos]).where(F.col("rn") <= k).drop("_prev")
