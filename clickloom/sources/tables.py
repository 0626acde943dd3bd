"""Reading tables, files and topics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_events(
    df: DataFrame,
    day: str,
    days: Sequence,
    like: tuple[str, str] | None = None,
    exclude: tuple[str, Sequence] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Rows of the listed days; a text column like a pattern, another not in a list, required columns
    neither null nor empty. All of it reaches the scan as partition and row-group filters."""
    # Values of the column's own type: a cast of the column would keep the filter out of the scan.
    out = df.where(F.col(day).isin(*[F.lit(d).cast(df.schema[day].dataType) for d in days]))
    if like:
        out = out.where(F.col(like[0]).like(like[1]))
    if exclude:
        out = out.where(~F.col(exclude[0]).isin(*exclude[1]))
    for c in required:
        out = out.where(F.col(c).isNotNull())
        if isinstance(df.schema[c].dataType, T.StringType):
            out = out.where(F.col(c) != "")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a header; without a schema the types are inferred, which costs one more pass."""
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Typed rows and the malformed lines, kept apart instead of failing the job."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    raw = spark.read.text(path).select("value", F.from_csv("value", full.simpleString()[7:-1].replace(":", " "), options).alias("_r"))
    good = raw.where(F.col("_r._bad").isNull()).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return good, raw.where(F.col("_r._bad").isNotNull()).select(F.col("value").alias("line"))


def read_labelled_text(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """One sentence per line; the label of a line is that of its file or folder: (text, label).

    Paths match whole segments; of nested folders the innermost gives the label.
    """
    label: Column | None = None
    name = F.concat("_metadata.file_path", F.lit("/"))
    for lab, path in sorted(files.items(), key=lambda f: -len(f[1].rstrip("/"))):
        hit = name.contains("/" + re.sub("^[a-z0-9]+:(//[^/]*)?", "", path).strip("/") + "/")
        label = F.when(hit, lab) if label is None else label.when(hit, lab)
    return spark.read.text(list(files.values())).select(F.trim("value").alias("text"), label.alias("label")).where(F.col("text") != "")


def read_topic(spark: SparkSession, fmt: str, options: Mapping[str, str], schema: T.StructType | str | None = None, path: str | None = None) -> DataFrame:
    """A streaming source: a message bus (value as text) or a folder of files with a schema."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path) if path else reader.load()
    return df.withColumn("value", F.col("value").cast("string")) if fmt == "kafka" else df


def trigger_options(interval: str | None = None, max_per_trigger: int | None = None, fmt: str = "kafka") -> dict[str, dict]:
    """Micro-batch pace: trigger arguments and the read cap of the source."""
    cap = "maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger"
    return {
        "trigger": {"processingTime": interval} if interval else {"availableNow": True},
        "source": {cap: str(max_per_trigger)} if max_per_trigger else {},
    }


def decode_json(df: DataFrame, value: str, schema: T.StructType | str) -> DataFrame:
    """JSON payload as columns beside the others; malformed payloads give nulls."""
    parsed = df.withColumn("_j", F.from_json(value, schema))
    return parsed.select(*[c for c in df.columns if c != value], "_j.*")


def split_words(df: DataFrame, text: str, sep: str = r"\s+") -> DataFrame:
    return df.select(F.explode(F.split(text, sep)).alias("word")).where(F.col("word") != "")


def daily_indicators(spark: SparkSession, sql: str, biz_date: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run an indicator query with the date as a bound parameter and add it as a typed column."""
    out = spark.sql(sql, args={"biz_date": biz_date}, **(views or {}))
    return out.withColumn("biz_date", F.to_date(F.lit(biz_date)))
