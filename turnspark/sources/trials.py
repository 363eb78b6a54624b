"""Trial tables: one row per trial with a channels x time array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspark.ranking import position_rows

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("subject", T.IntegerType()),
        T.StructField("trial", T.LongType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)


def load_trials(
    df: DataFrame, subjects: Sequence[int] = (), labelled: bool = True, order: Sequence = ()
) -> DataFrame:
    """Check and cast a trial table.

    ``x`` (and ``y`` when labelled) must exist and every expected subject must be
    present. Trials without a number are numbered in the declared ``order``.
    """
    needed = ["x", "y"] if labelled else ["x"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    if subjects:
        present = {
            r[0]
            for r in df.where(F.col("subject").isin(list(subjects)))
            .select("subject")
            .distinct()
            .collect()
        }
        absent = sorted(set(subjects) - present)
        if absent:
            raise ValueError(f"subjects without trials: {absent}")
    out = df.withColumn("x", F.col("x").cast("array<array<float>>"))
    if labelled:
        out = out.withColumn("y", F.col("y").cast("bigint"))
    if "trial" not in out.columns:
        if not order:
            raise ValueError("trials without numbers need a declared order")
        out = position_rows(out, list(order), "trial")
    return out
