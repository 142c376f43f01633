"""Headline queries, timed one by one; prints one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, all headline queries when unset).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftwright.plans import QUERIES  # noqa: E402
from siftwright.session import local_session  # noqa: E402

HEADLINE = [
    "impact_naive_audited", "repaired_facts", "issue_register", "dup_classes", "dup_keep_first", "dup_row_flags",
    "before_start_summary", "table_shape", "profile_numeric", "profile_values", "quantile_profile", "describe_subset",
    "hist_equal_width", "key_coverage", "grid_missing_cells", "missing_by_segment", "iqr_outliers", "gap_scan",
    "moments_adjusted", "label_rate_by_quantile", "welch_t", "chi2_yates", "ks_uniform", "panel_features_trend",
    "feature_table", "stratified_folds", "roc_auc", "average_precision", "cost_sweep", "decile_lift", "calibration",
    "rank_ensemble", "psi_by_period", "psi_customer_panel", "linear_attribution", "stream_window_profile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores)
    # start-up of the engine is not part of any query
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
