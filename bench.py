"""Headline timings: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from cohortloom.shipping import ship  # noqa: E402
from study import catalog  # noqa: E402

# the resampling queries run 100 to 2,000 replicates since the first timings and would not compare with them
HEADLINE = (
    "rising_share_by_group", "visit_numbering", "slope_per_subject", "feature_quality_filter", "size_factors",
    "exact_quantiles", "fdr_adjust", "feature_models", "moderated_t", "visit_correlations", "mutual_information",
    "first_information_cut", "information_gain", "nearest_neighbours", "roc_auc", "restricted_deviance", "subject_deviations", "progression_associations",
    "logistic_model", "events_nearby",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("cohortloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm-up
    ship(spark)
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
