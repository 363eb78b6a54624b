"""Joins that survive one key holding a large share of the rows.

Heavy keys are found in one pass with the bounded ``approx_top_k`` sketch. The
sketch only decides which keys get salted, so its approximation can cost time
but never changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 64
HOT_SHARE = 0.01
TASK_BYTES = 1 << 20  # of text that one task cuts into pieces


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> Column:
    """Scalar array with the (at most HOT_KEYS) key strings above ``share`` of the rows."""
    named = df.select(key.alias("hot_key"))
    summary = named.agg(
        F.expr(f"approx_top_k(hot_key, {HOT_KEYS})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    heavy = F.transform(
        F.filter("top", lambda t: t["count"] >= F.greatest(F.col("n") * share, F.lit(2))),
        lambda t: t["item"],
    )
    return summary.select(heavy.alias("hot")).scalar()


def _key_text(on: Sequence[str]) -> Column:
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in on])


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
    hot: Column | None = None,
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` that holds one row per key.

    Only heavy keys are salted: their rows spread over ``salts`` partitions (by default
    all shuffle partitions) by a hash of ``spread_by`` and their single lookup row is
    repeated that often, which adds at most HOT_KEYS x salts small rows. ``hot`` is an array of the
    heavy key strings where the caller knows them; otherwise a pass over the rows finds them.
    """
    on = list(on)
    salts = salts or shuffle_partitions(rows)
    hot = hot_keys(rows, _key_text(on)) if hot is None else hot
    is_hot = F.array_contains(hot, _key_text(on))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(copies))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a step that multiplies them.

    The explicit partition count stops AQE from merging partitions by their size
    before the step.
    """
    return df.repartition(shuffle_partitions(df), *keys)


def spread_texts(df: DataFrame, *keys: str) -> DataFrame:
    """:func:`spread_rows` for rows whose texts are about to be cut into pieces and counted.

    Pieces take a hundred times the room of their text, so the number of partitions grows with the
    bytes of the text columns: a task's tables stay in memory however large the input is.
    """
    return df.repartition(text_partitions(df, *keys), *keys)


def text_partitions(df: DataFrame, *keys: str) -> int:
    """Partitions of some TASK_BYTES of text, in the columns other than ``keys``."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keys]
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    total = sum(df.agg(*sizes).first()) if sizes else 0
    return max(shuffle_partitions(df), math.ceil(total / TASK_BYTES))
