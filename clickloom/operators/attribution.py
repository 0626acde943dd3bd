"""Who contributed how much to a combined gain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.skew import salted_join, with_blocks

# By how much the logarithm of a group's product may change within one panel; 32 nodes are exact to a double's digits there.
PANEL = 16.0


def shapley(df: DataFrame, group: Sequence[str], player: str, gain: str, nodes: int = 32) -> DataFrame:
    """Shapley value of each player for the gain ``prod(1 + x) - 1`` of its group, and its share.

    For this gain the average over all orders equals ``x_i`` times the integral over t in [0, 1] of
    ``prod over the others of (1 + t x_j)``. The product at a fixed t is a sum of logarithms, i.e. an
    ordinary partial aggregate, so no subset is listed and no large group is gathered. Gauss-Legendre with
    ``nodes`` points is exact up to ``2 nodes`` players; such a group is summed as one short list. In a larger group the interval is cut into panels, as many as the
    group's sum of ``abs(log1p(x))`` asks for, so that the logarithm of the product changes by about ``PANEL`` in each; (group, panel)
    rows hold the sums, and values stay in log scale until they are divided by the group's own product. A product or
    value beyond the range of a double is infinite, the share is not touched by that. Gains must be above -1, and a player
    of a large group stands once in it.
    """
    points, weights = np.polynomial.legendre.leggauss(nodes)
    points, weights = ((points + 1) / 2).tolist(), (weights / 2).tolist()
    x, keys = F.col(gain), list(group)
    # Groups are told apart by their size alone; a small one is one short list, its sums are never columns of an aggregate.
    sized = with_blocks(df.select(*keys, player, gain).dropna(subset=keys), keys, 2 * nodes, "_of")
    lists = sized.where("_of = 1").groupBy(*keys).agg(F.collect_list(F.struct(F.col(player).alias("_p"), x.cast("double").alias("_x"), x.alias("_g"))).alias("_all"))
    known = F.filter(F.col("_all._x"), lambda v: v.isNotNull())
    summed = lambda t: F.when(F.size("_known") > 0, F.aggregate("_known", F.lit(0.0), lambda a, v: a + F.log1p(t * v)))
    spots = F.lit([[t, w] for t, w in zip(points, weights, strict=True)])
    lists = lists.withColumn("_known", known).withColumn("_v", summed(F.lit(1.0)))
    # Per node: its place and its weight times the product of the group there.
    lists = lists.withColumn("_at", F.transform(spots, lambda s: F.struct(s[0].alias("t"), (s[1] * F.exp(summed(s[0]))).alias("e"))))
    terms = F.aggregate("_at", F.lit(0.0), lambda a, s: a + s["e"] / (1.0 + s["t"] * F.col("_x")))
    total = F.expm1("_v")
    few = lists.select(*keys, "_v", "_at", F.inline("_all"))
    few = few.withColumn("shapley", F.col("_x") * terms).withColumn("share", F.when(total != 0, F.col("shapley") / total))
    few = few.withColumnsRenamed({"_p": player, "_g": gain})

    rows = sized.where("_of > 1").drop("_of")
    grows = F.sum(F.abs(F.log1p(x)))
    large = rows.groupBy(*keys).agg(F.sum(F.log1p(x)).alias("_v"), (F.ceil(grows / PANEL) + 1).cast("int").alias("_panels"))
    sums = F.array(*[f"_l{i}" for i in range(nodes)])
    cut = salted_join(rows, large, keys).withColumn("_panel", F.explode(F.sequence(F.lit(0), F.col("_panels") - 1)))
    at = [(F.col("_panel") + F.lit(t)) / F.col("_panels") for t in points]
    logs = cut.groupBy(*keys, "_panel").agg(*[F.sum(F.log1p(t * x)).alias(f"_l{i}") for i, t in enumerate(at)])
    cut = salted_join(cut, logs.select(*keys, "_panel", sums.alias("_logs")), [*keys, "_panel"])
    # Relative to the product of all, which a share divides by.
    scale = F.greatest(F.col("_v"), F.lit(0.0))
    part = sum((F.lit(w) * F.exp(F.col("_logs")[i] - scale) / (1.0 + t * x) for i, (t, w) in enumerate(zip(at, weights, strict=True))), F.lit(0.0))
    many = cut.withColumn("_part", part / F.col("_panels")).groupBy(*keys, player, gain).agg(F.sum("_part").alias("_scaled"), F.max("_v").alias("_v"))
    scaled, whole = x * F.col("_scaled"), F.exp(F.col("_v") - scale) - F.exp(-scale)
    many = many.withColumn("shapley", scaled * F.exp(scale)).withColumn("share", F.when(whole != 0, scaled / whole))

    columns = [*keys, player, gain, "shapley", "share"]
    return few.select(*columns).unionByName(many.select(*columns))


def reward_split(shares: DataFrame, share: str, base: float | Column, project_ratio: float) -> DataFrame:
    """What each player keeps after the lead's base and the lead's part of every project."""
    b = F.lit(base) if isinstance(base, (int, float)) else base
    return shares.withColumn("reward", F.col(share) * (1 - b) * (1 - project_ratio))


def lead_share(shares: DataFrame, group: Sequence[str], share: str, base: float, project_ratio: float) -> DataFrame:
    """The lead's base plus its part of every project."""
    return shares.groupBy(*group).agg((F.lit(base) + F.sum(F.col(share) * (1 - base) * project_ratio)).alias("lead"))
