"""Seconds of the headline queries, as one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("metrics_summary", "profile_coverage", "series_quality", "quality_rollup", "counter_shape", "pivot_wide", "zscore_params", "window_scores", "healthy_threshold", "sustained_runs", "detection_lookback", "alarm_fatigue", "fleet_report", "psi_drift", "change_point", "forecast_accuracy", "soft_assignment", "silhouette")


def main() -> None:
    from pyspark.sql import SparkSession

    from brightwell.plans.registry import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # once over the smallest tables, so that code is compiled and Python workers are up; "first" is what that takes
    small, began = Path(SF).parent / "sf0.001", time.time()
    for name in HEADLINE if small.is_dir() else ("metrics_summary",):
        QUERIES[name](spark, str(small) if small.is_dir() else SF).write.format("noop").mode("overwrite").save()
    first = round(time.time() - began, 3)
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF).name, "first": first}))
    spark.stop()


if __name__ == "__main__":
    main()
