"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tablefit.catalogue import QUERIES

HEADLINE = (
    "profile_columns", "profile_table", "profile_correlations", "completeness_score", "consistency_score",
    "duplicate_rows", "uniqueness_score", "cadence_stats", "half_split_drift", "heavy_tail_columns",
    "balance_classification", "task_probabilities", "flagship_fitness", "calibrate_weights", "ranked_actions",
    "fix_sort_dedup", "fix_winsorize", "fix_resample", "fix_impute", "split_random", "split_stratified",
    "lag_features", "metric_f1", "model_regressor", "id_set_hash", "content_hash", "double_run_diff",
    "spearman_by_group", "signed_rank_exact", "anomaly_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tablefit-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "OFF").getOrCreate()
    )
    QUERIES["profile_shape_stats"](spark, folder).count()  # warms the session up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
