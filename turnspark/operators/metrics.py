"""Scores of predictions. Everything is read off one small table of (label, prediction) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _ratio(top: Column, bottom: Column) -> Column:
    """0/0 counts as 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def pair_counts(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Rows per (by..., label, pred); combines map-side and stays tiny."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_distribution(df: DataFrame, domain: Sequence[int], label: str = "label") -> DataFrame:
    """One row per domain label with its count (zero kept) and the max/min imbalance ratio."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.agg(
        *[_count(F.col("label") == F.lit(v)).alias(f"c{i}") for i, v in enumerate(domain)]
    )
    every = F.array(*[F.col(f"c{i}") for i in range(len(domain))])
    ratio = F.when(F.array_min(every) > 0, F.array_max(every) / F.array_min(every))
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("label"), F.col(f"c{i}").alias("n"))
            for i, v in enumerate(domain)
        ]
    )
    return (
        cells.withColumn("imbalance", ratio)
        .withColumn("e", F.explode(entries))
        .select("e.label", "e.n", "imbalance")
    )


def id_uniqueness(df: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows against distinct ids."""
    per_id = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_ids")
    )


def confusion_matrix(
    df: DataFrame,
    domain: Sequence[int],
    by: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """Every (label, pred) cell of the domain, empty cells included."""
    pairs = [(a, b) for a in domain for b in domain]
    counts = pair_counts(df, by, label, pred)
    wide = counts.groupBy(*by).agg(
        *[
            _count((F.col("label") == a) & (F.col("pred") == b)).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{i}").alias("n")
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.withColumn("e", F.explode(cells)).select(*by, "e.label", "e.pred", "e.n")


def class_scores(
    df: DataFrame,
    domain: Sequence[int],
    by: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1 and support."""
    wide = (
        pair_counts(df, by, label, pred)
        .groupBy(*by)
        .agg(
            *[
                F.struct(
                    F.lit(c).alias("label"),
                    _count((F.col("label") == c) & (F.col("pred") == c)).alias("tp"),
                    _count((F.col("label") != c) & (F.col("pred") == c)).alias("fp"),
                    _count((F.col("label") == c) & (F.col("pred") != c)).alias("fn"),
                ).alias(f"s{i}")
                for i, c in enumerate(domain)
            ]
        )
    )
    rows = wide.withColumn("e", F.explode(F.array(*[f"s{i}" for i in range(len(domain))])))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        rows.select(*by, "e.*")
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("support", tp + fn)
    )


def classification_report(
    df: DataFrame,
    domain: Sequence[int],
    by: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """Class rows plus accuracy, macro and weighted averages (row names in ``name``)."""
    scores = class_scores(df, domain, by, label, pred)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    summary = scores.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        _ratio(F.sum("tp"), total).alias("acc"),
        total.alias("total"),
    )

    def line(name: str, p: str, r: str, f: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.col(p).alias("precision"),
            F.col(r).alias("recall"),
            F.col(f).alias("f1"),
            F.col("total").alias("support"),
        )

    averages = summary.withColumn(
        "e",
        F.explode(
            F.array(
                line("accuracy", "acc", "acc", "acc"),
                line("macro avg", "m_precision", "m_recall", "m_f1"),
                line("weighted avg", "w_precision", "w_recall", "w_f1"),
            )
        ),
    ).select(*by, "e.*")
    classes = scores.select(
        *by, F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support"
    )
    return classes.unionByName(averages)


def macro_f1(
    df: DataFrame,
    domain: Sequence[int],
    by: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """Mean class F1 over the labels seen in either column."""
    seen = class_scores(df, domain, by, label, pred).where("tp + fp + fn > 0")
    return seen.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def summarize_oof(
    df: DataFrame, domain: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """One row: macro-F1, class F1s, confusion and prediction counts of a two-class table."""
    zero, one = domain
    wide = (
        pair_counts(df, by)
        .groupBy(*by)
        .agg(
            _count((F.col("label") == zero) & (F.col("pred") == zero)).alias("tn"),
            _count((F.col("label") == zero) & (F.col("pred") == one)).alias("fp"),
            _count((F.col("label") == one) & (F.col("pred") == zero)).alias("fn"),
            _count((F.col("label") == one) & (F.col("pred") == one)).alias("tp"),
        )
    )
    f0 = _ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp"))
    seen0 = (F.col("tn") + F.col("fp") + F.col("fn") > 0).cast("int")
    seen1 = (F.col("tp") + F.col("fp") + F.col("fn") > 0).cast("int")
    return (
        wide.withColumn("class0_f1", f0)
        .withColumn("class1_f1", f1)
        .withColumn("macro_f1", (F.col("class0_f1") + F.col("class1_f1")) / (seen0 + seen1))
        .withColumn("predicted0", F.col("tn") + F.col("fn"))
        .withColumn("predicted1", F.col("tp") + F.col("fp"))
    )


def fold_summary(
    scores: DataFrame, score: str, fold: str = "fold", by: Sequence[str] = ()
) -> DataFrame:
    """Mean, population deviation and the rounded fold scores in fold order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(fold), F.round(score, 4).alias("s"))))
    return scores.groupBy(*by).agg(
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.transform(ordered, lambda e: e["s"]).alias("fold_scores"),
    )


def accuracy(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred"):
    return df.groupBy(*by).agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def loso_report(df: DataFrame, key: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy per held-out group, with the mean and population deviation over groups."""
    groups = accuracy(df, [key], label, pred)
    overall = groups.agg(
        F.struct(F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("s")).alias("o")
    ).scalar()
    return groups.withColumn("mean_accuracy", overall["m"]).withColumn(
        "std_accuracy", overall["s"]
    )


def accuracy_and_logloss(
    df: DataFrame,
    probs: str = "probs",
    label: str = "label",
    by: Sequence[str] = (),
    floor: float = 1e-12,
) -> DataFrame:
    """Hit rate and mean cross-entropy over all rows."""
    from turnspark.functions.scores import argmax_label

    own = F.greatest(F.element_at(probs, F.col(label) + 1).cast("double"), F.lit(floor))
    hit = (argmax_label(F.col(probs)) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(
        F.avg(hit).alias("accuracy"), F.avg(-F.log(own)).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
    )


def confidence_summary(
    changed: DataFrame, threshold: Column | float, prob: str = "prob", by: Sequence[str] = ()
) -> DataFrame:
    """Margins and probabilities of the changed rows; nulls with count 0 when there are none."""
    from turnspark.functions.scores import margin

    gap = margin(F.col(prob), threshold)
    return changed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(gap).alias("min_margin"),
        F.avg(gap).alias("mean_margin"),
        F.min(prob).alias("min_prob"),
        F.max(prob).alias("max_prob"),
    )


# Positive and negative cuts are stated as pairs, not derived, so that
# 1 - 0.99 cannot miss 0.01 by a rounding error.
PSEUDO_CUTS = ((0.99, 0.01), (0.98, 0.02), (0.95, 0.05))


def pseudo_label_counts(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Rows confident enough to be pseudo labels at each cut, from one aggregate."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(hi).alias("cut"),
                F.count_if(F.col(prob) >= hi).alias("positive"),
                F.count_if(F.col(prob) <= lo).alias("negative"),
            ).alias(f"s{i}")
            for i, (hi, lo) in enumerate(PSEUDO_CUTS)
        ]
    )
    names = [f"s{i}" for i in range(len(PSEUDO_CUTS))]
    return wide.select(F.explode(F.array(*names)).alias("e")).select("e.*")
