"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f1_score_breakdown_lineitem", "f2_evaluation_summary", "f5_length_summary", "f8_failure_counts", "f12_score_matrix", "f15_usage_totals",
    "g1_top_k_per_key", "g4_first_passing_candidate", "g8_failing_streaks", "g11_rate_limit_alerts", "g13_dedupe_standards",
    "e3_scored_item_join", "e5_merge_by_rank", "e10_retrieve_examples", "e12_compare_runs", "e14_usage_with_price",
    "b1_chat_text", "i1_build_sft", "i4_encode_sft", "d1_validate_schema", "d8_validate_and_fix", "c1_parse_responses", "h3_keyed_rules", "a4_cap_per_file",
]


def main() -> None:
    from itemspark.catalog import QUERIES
    from itemspark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            t0 = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        took[name] = round(statistics.median(times[1:]), 3)
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
