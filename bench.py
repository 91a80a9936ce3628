"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every result
is computed in full (written to Spark's no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from flowlens.queries import all_queries  # noqa: E402

HEADLINE = [
    "a01_class_distribution", "a05_cell_profile", "a08_scaler", "a13_confusion_shares", "a18_metrics_by_split",
    "a20_split_shift", "a28_family_predictions", "a34_health", "a35_feature_drift", "f01_family_of_class", "f03_skew_log",
    "f04_standardized", "j03_weight_lookup", "m09_fine_scoring", "m10_coarse_scoring", "o01_balanced_sample",
    "o03_stratified_split", "o06_stratified_folds", "o10_row_index", "p04_median_impute", "p07_distinct_rows",
    "s01_csv_files", "s04_json_records", "s07_split_sink", "t01_stream_scoring", "t03_windowed_health",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["a04_observed_classes"](spark, folder).collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
