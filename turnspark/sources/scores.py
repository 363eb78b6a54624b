"""Score tables kept between runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnspark.operators import metrics as m
from turnspark.operators import thresholds as th

KEYS = ["experiment", "seed", "split"]


def save_scores(df: DataFrame, path: str) -> None:
    """Write rows with experiment, seed, split; only the partitions present are replaced.

    Columns: pos, id, label (null for unlabelled rows), prob.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*KEYS)
        .parquet(path)
    )


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def seed_metrics(scores: DataFrame, low=0.30, high=0.70, step=0.01) -> DataFrame:
    """Recompute raw and tuned macro-F1 of every stored run from its validation rows."""
    held = scores.where(F.col("split") == "valid")
    by = ["experiment", "seed"]
    raw = m.macro_f1(
        held.withColumn("pred", (F.col("prob") >= 0.5).cast("int")), (0, 1), by
    ).withColumnRenamed("macro_f1", "raw_macro_f1")
    tuned = th.tune_threshold_probs(held, "prob", "label", by, low, high, step).select(
        *by, "threshold", F.col("macro_f1").alias("threshold_macro_f1")
    )
    sizes = scores.groupBy(*by).agg(
        F.count_if(F.col("split") == "valid").alias("valid_count"),
        F.count_if(F.col("split") == "test").alias("test_count"),
    )
    return raw.join(tuned, by).join(sizes, by)


def missing_work(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """The wanted (experiment, seed, split) keys that are not stored yet."""
    try:
        done = load_scores(spark, path).select(*KEYS).distinct()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return wanted
    return wanted.join(done, KEYS, "left_anti")
