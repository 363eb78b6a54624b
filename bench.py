"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "endpoint_features",
    "normalize_text",
    "word_ngrams",
    "char_wb_ngrams",
    "tfidf",
    "fold_document_frequency",
    "stratified_kfold",
    "random_oversample",
    "classification_report",
    "tune_threshold_probs",
    "tune_threshold_per_fold",
    "tune_threshold_scores",
    "score_zscore_ensemble",
    "ensemble_mean",
    "confidence_gate",
    "gate_sweep",
    "common_split_compare",
    "exact_duplicate_transfer",
    "compare_labels",
    "validate_labels",
    "zscore_subject",
    "window_covariance_oas",
    "aligned_covariances",
    "whitened_second_moment",
    "filter_signals",
    "tangent_space",
    "mdm_leave_one_subject_out",
    "align_and_classify",
    "csp_ridge",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("turnspark")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from turnspark.queries import REGISTRY, load_all

    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
