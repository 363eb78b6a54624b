"""Validating label tables and comparing them with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["id", "label"]


def check_columns(df: DataFrame) -> None:
    """A label table has exactly the columns id and label, in this order."""
    data = [c for c in df.columns if c != "pos"]
    if data != COLUMNS:
        raise ValueError(f"expected columns {COLUMNS}, got {data}")


def validate_labels(sub: DataFrame, expected: DataFrame, domain: Sequence[int]) -> DataFrame:
    """Violations (rule, id, detail) of a label table against the expected ids and order.

    ``sub`` has pos, id, label and ``expected`` has pos, id; pos is the 0-based row order.
    Ids are grouped before the join, so a repeated id cannot multiply rows.
    """
    per_id = sub.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("got"))
    sides = per_id.join(
        expected.select("id", F.col("pos").alias("want")), "id", "full_outer"
    )
    rules = F.array(
        F.when(F.col("n").isNull(), F.struct(F.lit("missing_id").alias("rule"), F.lit("").alias("detail"))),
        F.when(
            F.col("want").isNull(),
            F.struct(F.lit("unexpected_id").alias("rule"), F.lit("").alias("detail")),
        ),
        F.when(
            F.col("n") > 1,
            F.struct(F.lit("duplicate_id").alias("rule"), F.col("n").cast("string").alias("detail")),
        ),
        F.when(
            F.col("got") != F.col("want"),
            F.struct(
                F.lit("wrong_position").alias("rule"),
                F.concat_ws("/", F.col("got").cast("string"), F.col("want").cast("string")).alias(
                    "detail"
                ),
            ),
        ),
    )
    by_id = sides.select(
        F.col("id").cast("string").alias("id"), F.explode(F.array_compact(rules)).alias("v")
    ).select("v.rule", "id", "v.detail")

    number = F.expr("try_cast(label AS DOUBLE)")
    rule = (
        F.when(F.col("label").isNull(), "null_label")
        .when(number.isNull() | (number != F.floor(number)), "not_an_integer")
        .when(~number.isin([float(v) for v in domain]), "outside_domain")
    )
    by_label = (
        sub.withColumn("rule", rule)
        .where("rule is not null")
        .select(
            "rule",
            F.col("id").cast("string").alias("id"),
            F.coalesce(F.col("label").cast("string"), F.lit("")).alias("detail"),
        )
    )
    sizes = sub.agg(F.count(F.lit(1)).alias("got")).withColumn(
        "want", expected.agg(F.count(F.lit(1))).scalar()
    )
    by_size = sizes.where("got <> want").select(
        F.lit("row_count").alias("rule"),
        F.lit("").alias("id"),
        F.concat_ws("/", F.col("got").cast("string"), F.col("want").cast("string")).alias("detail"),
    )
    return by_id.unionByName(by_label).unionByName(by_size)


def compare_labels(candidates: DataFrame, references: DataFrame, expected_refs: Sequence[str]):
    """Hamming distance of every (candidate, reference) pair of label tables.

    ``candidates`` has candidate, id, label and ``references`` has reference, id, label.
    A reference without rows yields null, not an error. The changed ids themselves are
    rows of :func:`changed_rows`.
    """
    pairs = changed_base(candidates, references)
    counted = pairs.groupBy("candidate", "reference").agg(
        F.count_if(F.col("label") != F.col("ref_label")).alias("hamming"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    wanted = candidates.select("candidate").distinct().select(
        "candidate", F.explode(F.array(*[F.lit(r) for r in expected_refs])).alias("reference")
    )
    return wanted.join(counted, ["candidate", "reference"], "left").select(
        "candidate",
        "reference",
        "n_rows",
        "hamming",
        (F.col("hamming") == 0).alias("identical"),
    )


def changed_base(candidates: DataFrame, references: DataFrame) -> DataFrame:
    return candidates.join(
        references.select("reference", "id", F.col("label").alias("ref_label")), "id"
    )


def changed_rows(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """The ids behind every Hamming distance, as rows instead of one growing list."""
    return changed_base(candidates, references).where(F.col("label") != F.col("ref_label"))


def row_comparison(candidates: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Rows whose label differs from the reference; every row when there is none."""
    if reference is None:
        return candidates.select(
            "candidate",
            "id",
            "label",
            F.lit(None).cast("int").alias("ref_label"),
            F.lit(False).alias("changed"),
        )
    joined = candidates.join(
        reference.select("id", F.col("label").alias("ref_label")), "id", "left"
    )
    differs = F.col("ref_label").isNull() | (F.col("label") != F.col("ref_label"))
    return joined.where(differs).select(
        "candidate", "id", "label", "ref_label", F.col("ref_label").isNotNull().alias("changed")
    )


def same_split(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row telling whether two validation sequences (pos, id) are equal."""
    left = a.select("pos", F.col("id").alias("id_a"))
    right = b.select("pos", F.col("id").alias("id_b"))
    both = left.join(right, "pos", "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if(~F.col("id_a").eqNullSafe(F.col("id_b"))).alias("mismatches"),
    ).withColumn("same", F.col("mismatches") == 0)


def ensemble_validation(
    probs: DataFrame, split_is_common: bool, seed_scores: DataFrame, threshold: float
) -> DataFrame:
    """Score an ensemble: its averaged probabilities on a common split, else the mean seed score.

    ``probs`` has model, id, label, prob; ``seed_scores`` has one raw and tuned score per model.
    """
    from turnspark.operators.metrics import macro_f1

    if not split_is_common:
        return seed_scores.agg(
            F.avg("raw_f1").alias("raw_f1"), F.avg("tuned_f1").alias("tuned_f1")
        ).withColumn("validation_kind", F.lit("mean_of_seed_splits"))
    mean = probs.groupBy("id", "label").agg(F.avg("prob").alias("prob"))
    both = mean.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("raw_f1").alias("k"), (F.col("prob") >= 0.5).cast("int").alias("pred")),
                F.struct(
                    F.lit("tuned_f1").alias("k"),
                    (F.col("prob") >= F.lit(float(threshold))).cast("int").alias("pred"),
                ),
            )
        ).alias("e"),
    ).select("label", "e.k", "e.pred")
    scored = macro_f1(both, (0, 1), ["k"])
    return scored.groupBy().agg(
        F.max(F.when(F.col("k") == "raw_f1", F.col("macro_f1"))).alias("raw_f1"),
        F.max(F.when(F.col("k") == "tuned_f1", F.col("macro_f1"))).alias("tuned_f1"),
    ).withColumn("validation_kind", F.lit("common_split_ensemble"))


def domain_diff(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Values outside the domain and domain values that never occur."""
    spark = df.sparkSession
    kind = df.schema[column].dataType
    seen = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    wanted = spark.createDataFrame([(v,) for v in domain], f"value {kind.simpleString()}")
    extra = seen.join(F.broadcast(wanted), "value", "left_anti").withColumn(
        "side", F.lit("unexpected")
    )
    absent = wanted.join(seen, "value", "left_anti").withColumn("side", F.lit("absent"))
    return extra.unionByName(absent)
