"""Run a registered query and its SQL on the same files and compare the results as sets of rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
from collections import Counter
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import SparkSession

from clickloom.catalog import ORACLES, QUERIES

# Spark type to DuckDB type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v: Any) -> Any:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def compare(spark: SparkSession, folder: str, name: str) -> tuple[bool, str, int]:
    """(equal, message, rows); a query without SQL only has to give rows."""
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if node in plan:
            return False, f"the plan has a {node}", 0
    cols = sorted(df.columns)
    mine = [tuple(_plain(v) for v in r) for r in df.select(*cols).collect()]
    if name not in ORACLES:
        return bool(mine), "rows only" if mine else "no rows", len(mine)
    con = connect(folder)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    odd = [(f.name, f.dataType.simpleString(), types.get(f.name)) for f in df.schema.fields if TYPES.get(f.dataType.simpleString()) != types.get(f.name)]
    if odd:
        return False, f"types differ: {odd}", len(mine)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}", len(mine)
    order = [names.index(c) for c in cols]
    theirs = [tuple(_plain(r[i]) for i in order) for r in rel.fetchall()]
    a, b = Counter(mine), Counter(theirs)
    if a == b:
        return True, "ok", len(mine)
    return False, f"{len(mine)} vs {len(theirs)} rows; only here {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}", len(mine)
