"""Split and fold assignment as columns. Order inside a label is a seeded hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.operators.bounded import group_values, lookup
from turnspark.ranking import hash_rank, seeded_hash


def stratified_kfold(
    df: DataFrame, k: int, seed: int, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """Add ``fold`` in 0..k-1; per label the fold sizes differ by at most one."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = hash_rank(df, seeded_hash(seed, F.col(row_id)), F.col(row_id), [label], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def stratified_holdout(
    df: DataFrame, frac: float, seed: int, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """Add ``split``: round(frac * n) rows of every label are ``valid``, the rest ``train``."""
    ranked = hash_rank(df, seeded_hash(seed, F.col(row_id)), F.col(row_id), [label], "_rank")
    sizes = group_values(df, label, F.count(F.lit(1)))
    cuts = {c: math.floor(n * frac + 0.5) for c, n in sizes.items()}
    split = F.when(F.col("_rank") <= lookup(cuts, F.col(label)), "valid").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank")


def random_holdout(df: DataFrame, frac: float, seed: int, row_id: str = "id") -> DataFrame:
    """Add ``split`` without stratification; each side keeps at least one row."""
    ranked = hash_rank(df, seeded_hash(seed, F.col(row_id)), F.col(row_id), [], "_rank")
    n = df.agg(F.count(F.lit(1))).scalar()
    kept = F.floor(n * F.lit(1.0 - frac) + F.lit(0.5))
    kept = F.greatest(F.lit(1), F.least(kept, n - 1))
    split = F.when(F.col("_rank") <= kept, "train").otherwise("valid")
    return ranked.withColumn("split", split).drop("_rank")


def leave_one_group_out(df: DataFrame, key: str) -> DataFrame:
    """Every group is a fold of its own."""
    return df.withColumn("fold", F.col(key))


def hold_group(df: DataFrame, key: str, value: object) -> DataFrame:
    """One named group validates, all others train."""
    return df.withColumn(
        "split", F.when(F.col(key) == F.lit(value), "valid").otherwise("train")
    )


def quotas(counts: dict, n: int) -> dict:
    """Share ``n`` over the labels in proportion, largest remainder first, then by label."""
    total = sum(counts.values())
    exact = {c: n * m / total for c, m in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    left = n - sum(out.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - out[c]), c))[:left]:
        out[c] += 1
    return out


def stratified_subset(
    df: DataFrame, n: int, seed: int, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """Keep n rows with the label shares of the table; the whole table if it is smaller."""
    counts = group_values(df, label, F.count(F.lit(1)))
    if n >= sum(counts.values()):
        return df
    ranked = hash_rank(df, seeded_hash(seed, F.col(row_id)), F.col(row_id), [label], "_rank")
    return ranked.where(F.col("_rank") <= lookup(quotas(counts, n), F.col(label))).drop("_rank")
