"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

A shared intermediate (snapshots, segmented customers, models) is charged to the first query that needs it.
"""
import json
import os
import time

from staywise.plans.catalog import QUERIES
from staywise.session import local_session

HEADLINES = os.environ.get("BENCH_ONLY", "").split() or [
    "l1_monthly_revenue",
    "l3_repeat_purchase_rate",
    "p3_column_mapping",
    "c21_row_account",
    "c10_price_impute_product_median",
    "c13_suspicious_value",
    "q2_column_profile",
    "f1_build_orders",
    "f2_interpurchase_gaps",
    "f4_compute_features",
    "f9_make_snapshots",
    "f10_window_sensitivity",
    "r6_segment_summary",
    "v4_value_tier",
    "v6_favourite_category",
    "e3_pr_auc",
    "e9_decile_lift",
    "e11_calibration",
    "d1_monthly_summary",
    "d5_cohort_retention",
    "d8_quartiles_by_outcome",
    "d9_correlation",
    "k3_evaluate_k",
    "m5_model_selection",
    "x2_tree_contributions",
    "x7_permutation_importance",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8, memory="16g")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
