"""Scoring turns as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnspark.functions.scores import labels_from_scores, linear_score, logistic
from turnspark.functions.text import ENDPOINT_NAMES, endpoint_features


def score_turns(
    turns: DataFrame,
    weights: Sequence[float],
    intercept: float,
    threshold: float = 0.5,
    digits: int = 6,
) -> DataFrame:
    """Add the cue score ``prob`` and its ``label`` to rows with a text; no state, no shuffle."""
    kept = [c for c in turns.columns if c != "text"]
    cues = turns.select(*kept, *endpoint_features(F.col("text")))
    prob = F.round(logistic(linear_score([F.col(n) for n in ENDPOINT_NAMES], weights, intercept)), digits)
    scored = cues.select(*kept, prob.alias("prob"))
    return scored.withColumn("label", labels_from_scores(F.col("prob"), threshold))


def write_scores(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start writing a stream of scored turns as Parquet.

    The sink's log and the checkpoint commit each batch once, so a batch that is repeated after a
    restart adds no second copy of its rows. Both folders have to be shared ones.
    """
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All scored rows of committed batches."""
    return spark.read.parquet(path)
