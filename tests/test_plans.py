"""The shape of the plans: filters in the scan, narrow reads, early group limits, no cross joins."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from clickloom.catalog import QUERIES
from clickloom.plans.skew import with_group

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    text = plan(spark, "io1_scan_events")
    assert "In(o_orderdate" in text and "IsNotNull(o_custkey)" in text and "Not(EqualTo(o_orderstatus,P))" in text
    text = plan(spark, "pf3_log_filter")
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "re2_cooccurrence")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text and "l_comment" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("name", ["sl4_top_n_score", "w1_top_per_user", "tr1_cap_per_user", "ag7_value_counts", "st2_window_top_n", "re16_favorite_types"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "Partial" in text and "WindowGroupLimit" in text


def test_group_aggregates_run_once(spark):
    spark.conf.set("spark.clickloom.hotRows", "20")
    try:
        lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
        out = with_group(lines, ["l_suppkey"], total=F.sum("l_quantity"), n=F.count(F.lit(1)))
        out.collect()
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.clickloom.hotRows")
    assert "ReusedExchange" in text.split("Initial Plan")[0]


PURE = [
    "ag8_behavior_score", "sl4_top_n_score", "se1_sessionize", "se4_skipgram_pairs", "j7_asof_join", "tr4_resolve_conflicts", "re2_cooccurrence",
    "at1_shapley", "fe3_chi_square", "tx6_prefix_suggest", "st1_sliding_score", "mo6_streak_alerts", "re18_fm_score",
]


@pytest.mark.parametrize("name", PURE)
def test_no_cross_join_and_no_python_in_the_hot_path(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in text
