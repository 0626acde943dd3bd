"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import hot_rows, pair_block

# Longest list of large groups that is broadcast.
BROADCAST_ROWS = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows, and into how many blocks each should be split.

    At most ``total rows / rows`` keys can qualify, so the result is small enough to broadcast.
    """
    limit = rows or hot_rows(df.sparkSession)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_blocks"))
    )


def row_salt(df: DataFrame, blocks: Column) -> Column:
    """A block number taken from the row's own values, so a retried task repeats it."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), blocks).cast("int")


def salted_join(
    df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", rows: int | None = None
) -> DataFrame:
    """Join detail rows to a side with few rows per key; the rows of a hot key are spread over blocks.

    The side's row of a hot key is repeated once per block, all other rows keep a single block.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, rows)
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    left = df.join(F.broadcast(hot), keys, "left")
    left = left.withColumn("_salt", F.when(F.col("_blocks").isNull(), 0).otherwise(row_salt(df, blocks)))
    right = side.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    return left.drop("_blocks").join(right.drop("_blocks"), keys + ["_salt"], how).drop("_salt")


def with_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row without gathering a group in one task; null is a group of its own.

    The aggregates are computed once. Those of hot keys (at most total rows / limit) are broadcast and
    their rows are spread by a salt; all other rows meet their group's aggregates by the key.
    """
    keys, limit = list(keys), hot_rows(df.sparkSession)
    if not keys:
        whole = df.agg(*[a.alias(n) for n, a in aggs.items()])
        return df.withColumns({n: whole.select(n).scalar() for n in aggs})
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[a.alias(n) for n, a in aggs.items()])
    # Both uses read every column in the same order, which makes them one exchange: the aggregate runs once.
    hot = stats.where(F.col("_rows") > limit).select(
        *[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_h_{c}") for c in ("_rows", *aggs)]
    )
    left = df.join(F.broadcast(hot), [F.col(k).eqNullSafe(F.col(f"_hk{i}")) for i, k in enumerate(keys)], "left")
    spread = 1 + row_salt(df, F.ceil(F.col("_h__rows") / limit))
    left = left.withColumn("_salt", F.when(F.col("_h__rows").isNull(), 0).otherwise(spread).cast("int"))
    # Always 0, but not a constant: a constant would leave the join, and the shuffle, without the salt.
    zero = F.least(F.col("_rows"), F.lit(0)).cast("int").alias("_zero")
    plain = stats.select(*[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)], zero, *aggs)
    same = [F.col(k).eqNullSafe(F.col(f"_pk{i}")) for i, k in enumerate(keys)]
    joined = left.join(plain, [*same, F.col("_salt") == F.col("_zero")], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_h_{n}", n).alias(n) for n in aggs])


def with_blocks(df: DataFrame, keys: Sequence[str], block: int, name: str = "_of") -> DataFrame:
    """Add into how many blocks of about ``block`` rows the row's group should be cut (1 for most).

    The large groups are counted first: with none there is nothing to join, a list of checked length is
    broadcast, and a longer one is joined by its keys.
    """
    cut = cut_groups(df, keys, block, name)
    return df.withColumn(name, F.lit(1)) if cut is None else cut


def cut_groups(df: DataFrame, keys: Sequence[str], block: int, name: str = "_of") -> DataFrame | None:
    """``with_blocks``, or nothing if no group has more than ``block`` rows."""
    large = hot_keys(df, keys, block).withColumnRenamed("_blocks", name)
    found = large.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return None
    if found <= BROADCAST_ROWS:
        out = df.join(F.broadcast(large), list(keys), "left")
    else:
        out = salted_join(df, large, keys, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(1)))


def within_group_pairs(
    df: DataFrame, keys: Sequence[str], member: str, carry: Sequence[str] = (), block: int | None = None
) -> DataFrame:
    """Unordered pairs ``(a < b)`` of the distinct members of a group, once each.

    ``df`` holds one row per (keys, member); ``carry`` columns come back as ``<name>_a`` / ``<name>_b``.
    A large group is cut into blocks and each pair of blocks is one join key, so no task sees more than
    about ``block`` rows of a group on either side. Symmetric results need only this half of the pairs.
    """
    keys, carry = list(keys), list(carry)
    sized = with_blocks(df.select(*keys, member, *carry), keys, block or pair_block(df.sparkSession))
    sized = sized.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_of")).cast("int"))
    left = sized.select(
        *keys,
        F.col("_own").alias("_ba"),
        F.explode(F.sequence(F.col("_own"), F.col("_of") - 1)).alias("_bb"),
        F.col(member).alias("_ma"),
        *[F.col(c).alias(f"_{c}_a") for c in carry],
    )
    right = sized.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_ba"),
        F.col("_own").alias("_bb"),
        F.col(member).alias("_mb"),
        *[F.col(c).alias(f"_{c}_b") for c in carry],
    )
    # Rows multiply in this join, so its partitions must not be merged by their input size.
    parts, cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys + ["_ba", "_bb"]
    left, right = left.repartition(parts, *cells), right.repartition(parts, *cells)
    joined = left.join(right, cells).where(
        (F.col("_ba") < F.col("_bb")) | (F.col("_ma") < F.col("_mb"))
    )
    in_order = F.col("_ma") < F.col("_mb")
    out = [*keys, F.least("_ma", "_mb").alias("a"), F.greatest("_ma", "_mb").alias("b")]
    for c in carry:
        out.append(F.when(in_order, F.col(f"_{c}_a")).otherwise(F.col(f"_{c}_b")).alias(f"{c}_a"))
        out.append(F.when(in_order, F.col(f"_{c}_b")).otherwise(F.col(f"_{c}_a")).alias(f"{c}_b"))
    return joined.select(*out)


def mirror(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of symmetric pair rows, in one pass over them."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    both = F.array(
        F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b))
    )
    return pairs.select(F.explode(both).alias("_p"), *rest).select(f"_p.{a}", f"_p.{b}", *rest)
