"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Tokens are summed per cell (one value of each dimension). The cell weights are raked to each dimension's marginal in turn; a
document's probability follows from its cell's fitted weight. All column code; the cells are as many as the value
combinations present, never as many as the documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.stage import written

ROUNDS = 10


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0


def cell_tokens(docs: DataFrame, dims: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Tokens per cell; null is a value like any other."""
    return docs.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("cell"))


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets in proportion to a power of the present tokens: 1 keeps the shares, 0 makes all values equal."""
    sums = cells.groupBy(dim).agg(F.sum("cell").alias("_n")).where("_n > 0")
    return sums.select(dim, F.pow("_n", F.lit(float(power))).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``weight``, of sum 1, whose sums per value follow the targets.

    ``targets`` maps a dimension to (value, target) rows; only values with tokens can be met, so the targets are scaled to
    those present, and a value without a target gets none. Each round rakes every dimension once, in the given order.
    Cells without tokens keep weight 0.
    """
    out = cells.where("cell > 0").withColumn("weight", F.col("cell"))
    for dim, target in targets.items():
        want = target.select(F.col(dim).alias("_value"), F.col("target").cast("double").alias(f"_t_{dim}"))
        out = out.join(want, F.col(dim).eqNullSafe(F.col("_value")), "left").drop("_value")
        out = out.withColumn(f"_t_{dim}", F.coalesce(f"_t_{dim}", F.lit(0.0)))
    out = written(out, "cells")
    for _ in range(rounds):
        for dim in targets:
            here = Window.partitionBy(dim)
            out = out.withColumn("weight", F.try_divide(F.col("weight") * F.col(f"_t_{dim}"), F.sum("weight").over(here)))
            out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        out = written(out, "raked")
    total = out.agg(F.sum("weight")).first()[0]
    out = out.withColumn("weight", F.col("weight") / F.lit(float(total)) if total else F.lit(0.0))
    return out.drop(*[f"_t_{d}" for d in targets])


def calibrate(fitted: DataFrame, targets: Mapping[str, DataFrame], budget: float, rounds: int = ROUNDS) -> DataFrame:
    """The raked cells with ``expected`` tokens of the sample: at most ``cell``, and per value its target's part of ``budget`` tokens.

    Raking goes on with the excess of full cells: each value's factor is the one at which its cells, none above what it holds, sum
    to the target. Where all cells of a value are full before that, it gives all it has and its target is missed (``marginals``).
    """
    out = fitted.where("weight > 0").withColumn("_w", F.col("weight") * F.lit(float(budget)))
    for dim, target in targets.items():
        want = target.select(F.col(dim).alias("_value"), F.col("target").cast("double").alias("_t")).where("_t > 0")
        here = out.select(dim).distinct().join(want, F.col(dim).eqNullSafe(F.col("_value"))).select("_value", "_t")
        total = here.agg(F.sum("_t")).first()[0] or 1.0
        here = here.select("_value", (F.col("_t") / F.lit(float(total)) * F.lit(float(budget))).alias(f"_t_{dim}"))
        out = out.join(here, F.col(dim).eqNullSafe(F.col("_value"))).drop("_value")
    out = written(out, "aimed")
    for _ in range(rounds):
        for dim in targets:
            whole, room = Window.partitionBy(dim), F.col("cell") / F.col("_w")
            out = out.withColumn("_room", room)
            # The cells with as much room or more; the others are full. Sums of whole tokens are exact.
            open_ = Window.partitionBy(dim).orderBy(F.desc("_room"))
            out = out.withColumns({"_full": F.sum("cell").over(whole) - F.sum("cell").over(open_), "_rest": F.sum("_w").over(open_)})
            out = out.withColumn("_f", (F.col(f"_t_{dim}") - F.col("_full")) / F.col("_rest"))
            fits = F.when(F.col("_f") <= F.col("_room") * (1 + 1e-12), F.col("_room"))
            factor = F.coalesce(F.min_by("_f", fits).over(whole), F.max("_room").over(whole))
            out = out.withColumn("_w", F.col("_w") * factor).drop("_room", "_full", "_rest", "_f")
        out = written(out, "calibrated")
    return out.withColumn("expected", F.least("cell", "_w")).drop("_w", *[f"_t_{d}" for d in targets])


def marginals(mixed: DataFrame, targets: Mapping[str, DataFrame], tokens: str = "tokens") -> DataFrame:
    """(dim, value, target, expected) of a mix: shares of the tokens; a target is missed where the two differ."""
    out = None
    for dim, target in targets.items():
        here = mixed.groupBy(dim).agg(F.sum(tokens).alias("_n"), F.sum(F.col(tokens) * F.col("probability")).alias("_e")).where("_n > 0")
        want = target.select(F.col(dim).alias("_value"), F.col("target").cast("double").alias("_t"))
        here = written(here.join(want, F.col(dim).eqNullSafe(F.col("_value")), "left").withColumn("_t", F.coalesce("_t", F.lit(0.0))), "marginals")
        t, e = here.agg(F.sum("_t"), F.sum("_e")).first()
        part = here.select(F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("value"), (F.col("_t") / F.lit(t or 1.0)).alias("target"), (F.col("_e") / F.lit(e or 1.0)).alias("expected"))
        out = part if out is None else out.union(part)
    return out


def mix(
    docs: DataFrame,
    dims: Sequence[str],
    targets: Mapping[str, DataFrame],
    budget: float,
    doc_id: str = "doc_id",
    tokens: str = "tokens",
    rounds: int = ROUNDS,
    seed: int = 8,
    calibrated: bool = True,
) -> DataFrame:
    """The rows of ``docs`` with ``weight`` (fitted share of the cell), ``probability`` and ``sampled``.

    ``budget`` is the expected tokens of the sample as a part of all tokens. A document's probability is budget x fitted cell
    tokens / present cell tokens, at most 1: a cell that holds too few tokens gives all it has, and the others of its values make up
    for it (``calibrate``) unless ``calibrated`` is false. A budget that needs more tokens of a value than there are misses that
    target; ``marginals`` tells which. Documents without tokens, and cells without a target, have probability 0. The draw depends on the id and the seed only, so rows that share an
    id share their fate. An empty table gives an empty table.
    """
    cells = written(cell_tokens(docs, dims, tokens), "cell-tokens")
    fitted = rake(cells, targets, rounds)
    total = float(cells.agg(F.sum("cell")).first()[0] or 0)
    if calibrated:
        fitted = calibrate(fitted, targets, float(budget) * total, rounds).withColumn("_p", F.col("expected") / F.col("cell"))
    else:
        fitted = fitted.withColumn("_p", F.least(F.lit(1.0), F.lit(float(budget) * total) * F.col("weight") / F.col("cell")))
    # A small written table: Spark broadcasts it below its threshold and splits hot cells of a sorted join above.
    fitted = written(fitted.select(*[F.col(d).alias(f"_{i}") for i, d in enumerate(dims)], F.col("weight").alias("_w"), "_p"), "mix")
    kept = [c for c in docs.columns if c not in ("weight", "probability", "sampled")]
    # The row travels as one struct, so its column names cannot clash with those of the join.
    same = [F.col(f"row.{d}").eqNullSafe(F.col(f"_{i}")) for i, d in enumerate(dims)]
    out = docs.select(F.struct(*kept).alias("row")).join(fitted, same, "left")
    p = F.when(F.col(f"row.{tokens}") > 0, F.coalesce("_p", F.lit(0.0))).otherwise(0.0)
    return out.select(
        "row.*",
        F.coalesce("_w", F.lit(0.0)).alias("weight"),
        p.alias("probability"),
        (uniform(seed, F.col(f"row.{doc_id}")) < p).alias("sampled"),
    )
