"""Named queries over the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.ranks import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def ev(self) -> DataFrame:
        """Events with the item number from the payload."""
        return self.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")

    @property
    def texts(self) -> DataFrame:
        """Documents for work that is heavy per text; a table of few files is spread over all cores first."""
        return self.spread(self.documents.select("doc_id", "text"), "doc_id")

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(4 * cores, *keys) if len(df.inputFiles()) < cores else df

    @property
    def imp(self) -> DataFrame:
        """Order lines as impressions: the order is the request, a returned line counts as a click."""
        li = self.lineitem.select(
            F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("item"), "l_linenumber", "l_suppkey",
            "l_quantity", "l_extendedprice", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("clicked"),
        )
        return numbered(
            li, ["request"], ["l_linenumber", "item", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "pos"
        )


# The same helpers in SQL.
EV = (
    "(SELECT event_id, ts, user_id, event_type, value, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
)
IMP = (
    "(SELECT l_orderkey AS request, l_partkey AS item, l_linenumber, l_suppkey, l_quantity, l_extendedprice, "
    "l_shipdate, CAST(l_returnflag = 'R' AS INTEGER) AS clicked, row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem)"
)
WEIGHTS = {"view": 1, "click": 2, "signup": 3, "purchase": 4}
WSQL = (
    "(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)"
)


def uniform_sql(seed: int, *cols: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"((CAST(('0x' || substr(md5({text}), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0)"


def r6(col: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` as a query."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
