"""Comparing candidate models and label files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.operators import metrics as m
from turnspark.operators import thresholds as th


def common_split_scores(
    members: DataFrame, ensembles: Mapping[str, Sequence[str]], digits: int = 7
) -> DataFrame:
    """Raw and tuned macro-F1 of every model and ensemble on one validation split.

    ``members`` has id, label, model, score with the same ids for every model, so an
    average of scores is a true ensemble. All names are swept in one pass.
    """
    singles = members.select("id", "label", F.col("model").alias("name"), "score")
    named = singles
    for name, chosen in ensembles.items():
        mean = (
            members.where(F.col("model").isin(list(chosen)))
            .groupBy("id", "label")
            .agg(F.round(F.avg("score"), digits).alias("score"))
        )
        named = named.unionByName(
            mean.select("id", "label", F.lit(name).alias("name"), "score")
        )
    raw = m.macro_f1(
        named.withColumn("pred", (F.col("score") >= 0.5).cast("int")), (0, 1), ["name"]
    ).withColumnRenamed("macro_f1", "raw_f1")
    tuned = th.tune_threshold_probs(named, by=["name"]).select(
        "name", "threshold", F.col("macro_f1").alias("tuned_f1")
    )
    return raw.join(tuned, "name")


def run_summary(
    train: DataFrame, test: DataFrame, members: DataFrame, report: DataFrame
) -> DataFrame:
    """One nested row: table shapes, label counts, member scores and transfer counts."""
    shapes = train.agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.count_if(F.col("label") == 0).alias("train_label0"),
        F.count_if(F.col("label") == 1).alias("train_label1"),
    ).withColumn("test_rows", test.agg(F.count(F.lit(1))).scalar())
    scores = members.agg(
        F.array_sort(F.collect_list(F.struct("name", "threshold", "tuned_f1"))).alias("members")
    ).scalar()
    transfer = report.agg(
        F.struct(
            F.count(F.lit(1)).alias("exact_matches"),
            F.count_if(~F.col("unanimous")).alias("conflicts"),
            F.count_if("applied").alias("override_candidates"),
            F.count_if("applied").alias("applied_overrides"),
        ).alias("t")
    ).scalar()
    return shapes.withColumn("members", scores).withColumn("transfer", transfer)


def as_json(summary: DataFrame) -> DataFrame:
    """The summary row as one JSON document."""
    return summary.select(F.to_json(F.struct("*")).alias("summary"))
