"""Local benchmark: prints one JSON line with the seconds of each headline query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "c1_apply_stop_policy",
    "c2_policy_grid",
    "c4_trajectory_outcomes",
    "e7_gap_table",
    "e6_calibration_table",
    "e17_standardized_control",
    "e33_pairwise_metrics",
    "h1_confusion_bootstrap",
    "h3_residual_bootstrap",
    "h4_pair_bootstrap",
    "h5_target_bootstrap",
    "h7_threshold_bootstrap",
    "h8_cell_bootstrap",
    "e19_combo_coverage",
    "e23_missingness_audit",
    "b4_adapt_messages",
    "b9_expand_prefixes",
    "f1_lomo_split",
    "f4_vocabulary",
    "f6_fold_tfidf",
    "j9_replication_gate",
    "k3_decision_reproduction",
)


def main() -> None:
    from stopwise.plans.registry import all_queries
    from stopwise.session import local_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    queries = all_queries()
    spark.read.parquet(f"{path}/orders.parquet").selectExpr("count(*)").collect()
    seconds = {}
    for key in wanted:
        start = time.time()
        queries[key].run(spark, path).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
