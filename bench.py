"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma list
(``all`` for every registered query). Each result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickloom.catalog import QUERIES  # noqa: E402
from clickloom.session import build_session  # noqa: E402

HEADLINE = [
    "sl4_top_n_score",
    "se1_sessionize",
    "se2_session_sequences",
    "se4_skipgram_pairs",
    "tx1_query_cooccurrence_tfidf",
    "tx3_diversify_suggestions",
    "tx6_prefix_suggest",
    "tx8_phrase_match",
    "re1_swing_purchases",
    "re2_cooccurrence",
    "re5_knn_l2",
    "re8_interest",
    "j7_asof_join",
    "tr2_skip_above",
    "tr4_resolve_conflicts",
    "tr7_pairwise",
    "fe3_chi_square",
    "fe5_box_stats",
    "fe12_ordered_target",
    "fe13_char_ngrams",
    "fe17_rolling_stats",
    "st1_sliding_score",
    "st2_window_top_n_stream",
    "mo1_parse_service_log",
    "mo6_streak_alerts",
    "ev1_auc_logloss",
    "at1_shapley",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sl4_top_n_score"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
