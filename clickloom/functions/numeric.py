"""Number, vector and geometry column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(1 << 52)


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch with their fraction; a time without a zone is read in the session's."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def pct(col: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col * 100)


def stable_uniform(seed: int | str, *cols: Column) -> Column:
    """A number in (0, 1) that depends only on the values and the seed, never on the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / _TWO_52


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def polygon_area(points: Column) -> Column:
    """Shoelace area of a polygon given as an array of [x, y] points."""
    n = F.size(points)
    cross = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1],
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2
