"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose data and cores.
Every query is run once to warm up and then timed; the whole result is produced each time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flow_two_sided_agg", "flow_port_rank", "entity_levels_bins", "pair_agg", "sessions_gap", "session_keep",
    "sampling_audit", "dense_series_span", "bursts_by_entity", "bursts_from_series", "split_geometry",
    "mirror_by_time", "burst_expand_roundtrip", "quantile_levels_sketch", "tokens_global", "features_minimal",
    "features_extended", "invariance_scores", "cohens_d_rest", "cka_per_feature", "cka_per_cluster",
    "importance_topk", "direction_stats", "spectrum_stats", "ch_db_scores", "knn_exact_topk",
    "knn_cluster_topk", "ivf_search", "wasserstein_pairs", "dtw_pairs", "forecast_metrics", "merged_metrics",
]


def main() -> None:
    from burstseries import build_session
    from burstseries.plans.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g"),
            "spark.ui.showConsoleProgress": "false",
            # tiny shuffles: keep all cores busy instead of merging them into one task
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
