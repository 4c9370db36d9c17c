"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1 timed run after warm-up),
BENCH_QUERIES (comma list or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from shardlens.plans import catalog
from shardlens.session import local_session

HEADLINE = [
    "node_brief",
    "estimate_replicas",
    "replicas_by_node",
    "abnormal_partitions",
    "hub_constraint_audit",
    "primary_imbalance",
    "primary_switch_edges",
    "balance_report",
    "load_extremes",
    "add_candidates",
    "remove_candidates",
    "primary_candidates",
    "restart_impact",
    "reconcile_reports",
    "membership_consistency",
    "passive_role_targets_log_based",
    "placement_drift",
    "partition_resource",
    "table_resource_usage",
    "build_routes",
    "recover_membership",
    "split_progress",
    "restore_progress",
    "retention",
    "recent_runs",
    "liveness_changes",
    "placement_by_hub",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if asked == "all" else (asked.split(",") if asked else HEADLINE)
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
