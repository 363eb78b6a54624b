"""TF-IDF as a long (id, term, weight) table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspark.functions.grams import TOKENS, counted, runs
from turnspark.functions.text import Cut, cut_of
from turnspark.lineage import cut_lineage
from turnspark.shipping import ship_package
from turnspark.skew import lookup_join, spread_texts

BATCH = 1 << 16  # counts that leave a task at once


def term_counts(df: DataFrame, grams: Column, row_id: str = "id", tokens: int = TOKENS) -> DataFrame:
    """Rows (id, term, c).

    The documents are hashed by id before the n-grams are cut: the shuffle then
    carries each text once, and all rows of an id are counted in one task.
    """
    cut = cut_of(grams)
    if cut is not None:
        return _cut_counts(spread_texts(df, row_id).select(F.col(row_id).alias("id"), cut.tokens.alias("tokens")), cut, tokens)
    terms = spread_texts(df, row_id).select(F.col(row_id).alias("id"), F.explode(grams).alias("term"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))


def _cut_counts(rows: DataFrame, cut: Cut, most: int) -> DataFrame:
    """(id, term, c) of rows (id, tokens) that are hashed by id, counted ``most`` tokens at a time."""
    ship_package(rows.sparkSession)
    unit, low, high = cut.unit, cut.low, cut.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, owner in runs(batches, "id", "tokens", most):
            who, number, times, terms = counted(some.column("tokens"), owner, unit, low, high)
            first = np.r_[0, np.nonzero(np.diff(owner))[0] + 1]
            for at in range(0, len(who), BATCH):
                part = slice(at, at + BATCH)
                ids = some.column("id").take(pa.array(first[who[part]]))
                yield pa.RecordBatch.from_arrays([ids, terms.take(pa.array(number[part])), pa.array(times[part], pa.int64())], names=["id", "term", "c"])

    schema = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("c", T.LongType())])
    return rows.sortWithinPartitions("id").mapInArrow(run, schema)


def vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """Terms of the training rows with document frequency, corpus count and smoothed idf."""
    vocab = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("total"))
        .where(F.col("df") >= min_df)
    )
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0
    return vocab.withColumn("idf", idf)


def weigh(counts: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, term, w) with unit length per id; terms outside the vocabulary drop out."""
    fixed = cut_lineage(vocab.select("term", "idf"))
    joined = lookup_join(counts, fixed, ["term"], ["id"])
    tf = F.lit(1.0) + F.log("c") if sublinear else F.col("c").cast("double")
    raw = joined.select("id", "term", (tf * F.col("idf")).alias("_raw"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("_raw") / length).alias("w"))


def tfidf(
    df: DataFrame,
    grams: Column,
    min_df: int = 2,
    sublinear: bool = True,
    max_features: int | None = None,
    row_id: str = "id",
) -> DataFrame:
    """Fit on the rows of ``df`` and weigh the same rows."""
    counts = term_counts(df, grams, row_id)
    vocab = vocabulary(counts, df.count(), min_df, max_features)
    return weigh(counts, vocab, sublinear)


def fold_document_frequency(
    df: DataFrame, grams: Column, fold: str = "fold", row_id: str = "id"
) -> DataFrame:
    """Training document frequency of every term for every held-out fold.

    Total minus held-out: one pass over the n-grams serves all folds. Rows are
    (fold, term, train_df) with the zero rows left out.
    """
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    terms = spread_texts(df, row_id).select(
        row_id, F.col(fold).alias("_f"), F.explode(F.array_distinct(grams)).alias("term")
    )
    wide = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("_f") == F.lit(f)).alias(f"_h{i}") for i, f in enumerate(folds)],
    )
    per_fold = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold"), (F.col("total") - F.col(f"_h{i}")).alias("train_df")
            )
            for i, f in enumerate(folds)
        ]
    )
    return (
        wide.select("term", F.explode(per_fold).alias("e"))
        .select("e.fold", "term", "e.train_df")
        .where(F.col("train_df") > 0)
    )


def standard_scale(
    df: DataFrame, columns: list[str], with_mean: bool, out_prefix: str = "z_"
) -> DataFrame:
    """Scale columns by their population deviation; a constant column keeps its scale."""
    moments = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()

    def scaled(c: str) -> Column:
        spread = moments[f"s_{c}"] or 1.0
        centre = moments[f"m_{c}"] if with_mean else 0.0
        return ((F.col(c) - F.lit(centre)) / F.lit(spread)).alias(out_prefix + c)

    return df.select("*", *[scaled(c) for c in columns])
