"""Small aggregates of a closed domain, read as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GROUPS = 10_000


def group_values(df: DataFrame, key: str, value: Column, max_groups: int = MAX_GROUPS) -> dict:
    """key -> aggregate for a key from a closed domain such as class labels.

    The aggregation combines map-side and at most ``max_groups`` + 1 rows reach the
    driver; a key that turns out not to be a small domain is an error.
    """
    table = df.groupBy(F.col(key).alias("k")).agg(value.alias("v"))
    rows = table.limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"{key} has more than {max_groups} values")
    return {r["k"]: r["v"] for r in rows}


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key`` in a small dictionary."""
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*entries), key)
