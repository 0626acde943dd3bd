"""Keyed tables: upserts, lookups, wide cells, schema growth, expiry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.plans.ranks import top_n
from clickloom.plans.skew import salted_join


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """The row with the largest ``order_by`` per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order_by, *rest)).alias("_r"))
    return newest.select(*keys, "_r.*")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Base rows with the given fields replaced by the update of the same key; unknown keys are added.

    Fields an update leaves null keep their value. Of several updates to one key the last by
    ``order_by`` counts.
    """
    keys = list(keys)
    if order_by:
        updates = latest_per_key(updates, keys, order_by)
        if order_by not in base.columns:
            updates = updates.drop(order_by)
    else:
        rest = [c for c in updates.columns if c not in keys]
        updates = updates.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    fields = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = base.join(new, keys, "full")
    out = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns
    ] + [F.col(f"_new_{c}").alias(c) for c in fields if c not in base.columns]
    return joined.select(*out)


def multi_get(df: DataFrame, key: str, keys: DataFrame | Sequence[Any]) -> DataFrame:
    """Rows of the requested keys. A list becomes a pushed-down filter, a table a semi join."""
    if isinstance(keys, DataFrame):
        return salted_join(df, keys.select(key).distinct(), [key], "left_semi")
    return df.where(F.col(key).isin(*keys))


def cells_to_rows(
    df: DataFrame, key: str, family: str, qualifier: str, value: str, schema: Mapping[str, str], version: str | None = None
) -> DataFrame:
    """Cells to one typed row per key; ``schema`` maps ``family:qualifier`` to a type.

    The latest version of a cell wins. Columns are named in the schema, so no pass over the data is
    needed to find them.
    """
    def pick(cell: str, dtype: str) -> Column:
        fam, qual = cell.split(":", 1)
        here = (F.col(family) == fam) & (F.col(qualifier) == qual)
        val = F.when(here, F.col(value))
        agg = F.max_by(val, F.when(here, F.col(version))) if version else F.max(val)
        return agg.cast(dtype).alias(qual)

    return df.groupBy(key).agg(*[pick(c, t) for c, t in schema.items()])


def rows_to_cells(df: DataFrame, key: str, family_of: Mapping[str, str]) -> DataFrame:
    """One (key, family, qualifier, value) cell per non-null column value."""
    cells = [
        F.struct(F.lit(fam).alias("family"), F.lit(c).alias("qualifier"), F.col(c).cast("string").alias("value"))
        for c, fam in family_of.items()
    ]
    return df.select(key, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order; missing ones are null, extra ones stay at the end."""
    have = set(df.columns)
    wanted = [
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    names = {f.name for f in schema.fields}
    return df.select(*[c.alias(f.name) for c, f in zip(wanted, schema.fields, strict=True)], *[c for c in df.columns if c not in names])


def ensure_columns(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    missing = {c: F.lit(v) if not isinstance(v, Column) else v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def drop_expired(df: DataFrame, expires_at: str, now: Column) -> DataFrame:
    return df.where(F.col(expires_at).isNull() | (F.col(expires_at) > now))


def versioned_apply(base: DataFrame, changes: DataFrame, key: str, version: str, order_by: str) -> tuple[DataFrame, DataFrame]:
    """Apply changes whose expected version is the stored one; returns (new base, conflicts).

    Of several changes to one stored version the first by ``order_by`` wins; every other change is a
    conflict. An applied change raises the version by one.
    """
    fields = [c for c in changes.columns if c not in (key, version, order_by)]
    first = top_n(changes, [key, version], [order_by, *fields], 1).drop("rn")
    current = base.select(key, version)
    fits = first.join(current, [key, version], "left_semi")
    new = fits.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(1).alias("_hit"))
    joined = base.join(new, key, "left")
    hit = F.col("_hit").isNotNull()
    applied = joined.select(
        *[
            (F.col(version) + F.when(hit, 1).otherwise(0)).alias(c)
            if c == version
            else (F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c))
            for c in base.columns
        ]
    )
    conflicts = changes.join(fits.select(key, version, order_by), [key, version, order_by], "left_anti")
    return applied, conflicts
