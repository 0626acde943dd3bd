"""Row numbers, top-n and exact quantiles that do not gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.scans import OrderedRows, running_sum, sort_columns
from clickloom.plans.skew import with_group

# Spark keeps at most this many rows per group and task before the shuffle (WindowGroupLimit).
GROUP_LIMIT = 1_000


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """Exact row number of every row in its group."""
    out = OrderedRows(df, by, order).add(**{name: running_sum(F.lit(1))}).rows()
    return out.withColumn(name, F.col(name).cast("long"))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group; the order should end in a tie-break column.

    For small ``n`` Spark limits each group on the map side, so a hot group is cut before the shuffle.
    """
    if n > GROUP_LIMIT:
        return numbered(df, by, order, name).where(F.col(name) <= n)
    w = Window.partitionBy(*by).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("long"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linearly interpolated quantiles per group, from counted distinct values."""
    by = list(by)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    )
    placed = OrderedRows(counted, by, [value]).add(_cum=running_sum(F.col("_cnt"))).rows()
    if by:
        placed = with_group(placed, by, _total=F.sum("_cnt"))
    else:
        placed = placed.withColumn("_total", counted.agg(F.sum("_cnt")).scalar())
    parts, out = [], []
    for p, name in zip(probs, names, strict=True):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("_cum") - F.col("_cnt") <= idx) & (idx < F.col("_cum"))
            parts.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}_{name}"))
        parts.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return placed.groupBy(*by).agg(*parts).select(*by, *out)
