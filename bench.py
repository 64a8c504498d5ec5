"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores; BENCH_QUERIES (comma-separated) a
subset. Each query runs once to warm up and then up to BENCH_RUNS times; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from touchmark.plans import all_queries
from touchmark.session import build_session

HEADLINE = (
    "campaign_performance", "campaign_roas", "last_touch", "attribution_candidates",
    "rank_latest_touch", "attribution_cookie_then_hem", "roas_by_market", "customer_ltv",
    "customer_ltv_orders", "cac", "mer", "video_funnel", "creative_performance",
    "identity_resolve", "orphan_keys", "ctr_batch", "stream_ctr_batch_twin", "dq_scan",
    "dq_fill_contract", "dq_failing_rows", "dq_rule_diff", "profile_nulls", "profile_distinct",
    "profile_top_n", "profile_histogram", "profile_distribution", "discover_primary_keys",
    "discover_foreign_keys", "dataset_overview", "match_exact", "tokenize_description",
    "graph_edges", "path_campaign_creative_event", "path_hem_alternatives", "knn_exact", "knn_ivf",
    "topk_distance", "theme_similarity", "recommend_themes", "embed_text",
)


def run(query, spark, directory: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every column of every row and keeps nothing.
    query(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus})
    queries, seconds = all_queries(), {}
    for name in names:
        warm_up = run(queries[name], spark, directory)
        # Long queries vary little: one run tells as much as three.
        times = [run(queries[name], spark, directory) for _ in range(runs if warm_up < 8 else 1)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
