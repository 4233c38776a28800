"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog_fusion.checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "conform_union",
    "normalize_title",
    "parse_int_bounds",
    "collapse_by_id",
    "collapse_two_stage",
    "sequential_id",
    "profile_numeric",
    "calendar_features",
    "target_encode_fit",
    "target_encode_apply",
    "target_encode_apply_large",
    "temporal_split",
    "regression_metrics",
    "feature_matrix",
    "topn_slots",
    "scan_formats",
    "merge_job",
]
RUNS = 2
# Trains the model in full; later runs would only read it, so its first run counts.
TRAINING = "train_choose"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("catalog-fusion-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        # Small local files: enough splits for every core.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS + 1):  # the first run warms the JVM up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        start = time.perf_counter()
        QUERIES[TRAINING](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[TRAINING] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
