"""Seconds per headline query, first and warm run: prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "label_counts", "dataset_with_off", "clean_text", "multitask_examples", "bounded_tokens",
    "split_80_10_10", "kfold_all_k", "metrics_overall", "confusion_matrix", "softmax_scores",
    "early_stop", "runtime_by_run", "nb_model", "nb_predict", "nb_predict_large_vocabulary",
    "predict_all", "compare_models", "holdout_report", "kfold_results", "search_best",
    "batch_classifier", "logistic_regression",
)


def run(spark: SparkSession, sf: str, name: str) -> float:
    """All rows and columns are computed; nothing is collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    first = {name: run(spark, sf, name) for name in names}
    warm = {name: run(spark, sf, name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": {n: round(s, 3) for n, s in warm.items()},
                "first_run": {n: round(s, 3) for n, s in first.items()},
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
