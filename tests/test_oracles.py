"""Every registered query against its SQL, plain and with every key treated as hot."""

from __future__ import annotations

import pytest

from clickloom.catalog import ORACLES, QUERIES
from clickloom.catalog.compare import compare

FOLDER = "/root/testdata/sf0.001"

# Queries whose plan changes when keys are hot.
SPLIT = [
    "se1_sessionize", "se1_sessionize_12h", "se2_session_sequences", "se4_skipgram_pairs", "se5_negative_samples", "se7_random_walks",
    "se8_change_points", "j1_session_self_join", "j2_aggregate_join", "j7_asof_join", "j10_compute_missing", "w5_lag_diff", "w7_history_before",
    "ag5_collect_sorted", "f19_min_max", "re1_swing_purchases", "re1_swing_days", "re2_cooccurrence", "re11_weighted_shuffle", "re14_cold_item_vector",
    "fe3_chi_square", "fe5_box_stats", "fe6_discretize_quantile", "fe10_target_mean", "fe12_ordered_target", "fe17_rolling_stats", "fe18_category_share",
    "tr2_skip_above", "tr3_sample_ratio", "tr4_resolve_conflicts", "tr7_pairwise", "tr9_stratified_split", "tx1_query_cooccurrence_tfidf",
    "mo3_api_metrics", "mo3_latency_quantiles", "mo6_streak_alerts", "ev1_auc_logloss", "at1_shapley", "st10_flush_by_age",
]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note, _ = compare(spark, FOLDER, name)
    assert ok, note


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys(tiny_limits, name):
    ok, note, _ = compare(tiny_limits, FOLDER, name)
    assert ok, note


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
