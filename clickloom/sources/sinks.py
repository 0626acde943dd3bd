"""Writing tables: exports, partitions, bulk loads, publishing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.session import fresh_dir


def export(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write everything; returns the number of rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(fmt).save(path)
    return seen.get["n"]


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def partition_hour(now: datetime) -> str:
    """Partition value of a run: yesterday, to the hour."""
    return (now - timedelta(days=1)).strftime("%Y-%m-%d_%H")


def overwrite_partition(df: DataFrame, path: str, by: str, value: str) -> None:
    """Replace one partition and leave the others as they are."""
    (
        df.withColumn(by, F.lit(value))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def bulk_load(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    batch_size: int = 10_000,
    truncate: bool = True,
    casts: Mapping[str, str] | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> None:
    """Load columns in a fixed order; into a database, in batches, when ``jdbc`` options are given."""
    typed = df.select(*[F.col(c).cast(casts[c]).alias(c) if casts and c in casts else F.col(c) for c in columns])
    mode = "overwrite" if truncate else "append"
    if jdbc is not None:
        typed.write.format("jdbc").options(dbtable=target, batchsize=batch_size, truncate=truncate, **jdbc).mode(mode).save()
    else:
        typed.write.mode(mode).parquet(target)


def replace_table(df: DataFrame, target: str, rename: Mapping[str, str]) -> None:
    """Replace the target by a renamed subset of the columns."""
    df.select(*[F.col(a).alias(b) for a, b in rename.items()]).write.mode("overwrite").parquet(target)


def publish(
    spark: SparkSession, alias: str, build: Callable[[str], None], validate: Callable[[DataFrame], bool], pointer_dir: str | None = None
) -> str:
    """Build the standby copy, check it, and only then let the catalog's view point to it.

    The copies are ``<folder>/blue`` and ``<folder>/green``; the view is replaced in one step, every session of the catalog sees it,
    and its files show which copy is live. If the check fails the live copy stays, and the error names the standby.
    """
    folder = pointer_dir or fresh_dir(spark, alias)
    live = None
    if spark.catalog.tableExists(alias):
        files = spark.table(alias).inputFiles()
        seen = {c for c in ("blue", "green") for f in files if f"/{c}/" in f}
        if len(seen) > 1:
            raise RuntimeError(f"{alias} shows two copies")
        live = seen.pop() if seen else None
    standby = "green" if live == "blue" else "blue"
    target = f"{folder}/{standby}"
    build(target)
    fresh = spark.read.parquet(target)
    if not validate(fresh):
        raise RuntimeError(f"{target} failed its check, {alias} is unchanged")
    spark.sql(f"CREATE OR REPLACE VIEW {alias} AS SELECT * FROM parquet.`{target}`")
    return target
