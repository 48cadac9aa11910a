"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s03_panel_build", "w04_moving_averages", "w09_relative_strength", "w11_percentile_rank", "w13_daily_top_k",
    "w14_snapshot_as_of", "w16_forward_path", "w17_horizon_labels", "w22_leader_history", "x11_total_score",
    "x14_candidate_ranking", "a02_deals_summary", "a09_decile_table", "a10_precision_at_10", "a15_trade_evaluation",
    "a20_weight_generation", "a23b_mention_precedence_own_bars", "a25_exit_rule_table", "r05_recommendations",
    "w28_ledger_bar_walk", "a29_cohorts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    from tapewright.session import local_session

    spark = local_session(cpus, "tapewright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    from tapewright.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
