"""Summarise the physical plans of the registered queries (PLANS.md).

For each query: parquet scans, shuffle exchanges, join strategies, partial
aggregates, window group limits, Python evaluation nodes, and whether
filters were pushed into the scans. Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evalspark.plans.registry import load_all  # noqa: E402
from evalspark.session import build_session  # noqa: E402

SKIP_BUILD = {"greedy_matching", "dbscan", "pair_matching_distance", "scan_runs", "prune_runs", "split_by_key",
              "split_by_cluster", "gaussian_nb", "random_forest", "svm_classify", "linear_regression_fit",
              "unaware_compare", "kmeans", "pca_whiten", "weighted_episode_sample"}


def summarise(plan: str) -> dict:
    return {
        "scans": plan.count("FileScan parquet"),
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin"),
        "smj": plan.count("SortMergeJoin"),
        "partial_aggs": len(re.findall(r"partial_", plan)) and plan.count("HashAggregate") // 2 + plan.count("SortAggregate") // 2,
        "window_group_limit": "WindowGroupLimit" in plan,
        "python": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") + plan.count("MapInPandas"),
        "pushed_filters": len([m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m.strip()]),
        "nested_loop": "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=16)
    reg = load_all()
    print("# Physical plan summary\n")
    print(f"Generated by `tools/plan_report.py` over `{sf_dir}` (AQE initial plans). Iterative / writing queries "
          "run jobs while they are built and are listed without a plan.\n")
    print("| query | scans | shuffles | broadcast joins | sort-merge joins | partial aggs | window limit | "
          "python nodes | scans with pushed filters | nested loop |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, e in sorted(reg.items()):
        if name in SKIP_BUILD:
            print(f"| {name} | (iterative / writes while built) | | | | | | | | |")
            continue
        plan = e.fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {name} | {s['scans']} | {s['exchanges']} | {s['broadcast_joins']} | {s['smj']} | {s['partial_aggs']} | "
              f"{'yes' if s['window_group_limit'] else ''} | {s['python'] or ''} | {s['pushed_filters']} | "
              f"{'YES' if s['nested_loop'] else ''} |")
    for name in ("leaderboard", "nearest_previous_comment", "knn_search", "max_distance_row"):
        print(f"\n## `{name}` (explain formatted)\n\n```")
        df = reg[name].fn(spark, sf_dir)
        print(df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        print("```")
    spark.stop()


if __name__ == "__main__":
    main()
