"""Exact row numbers and order statistics without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnspark.lineage import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row counter in the low 33 bits
HASH_DIGITS = 4  # 16**4 buckets per group


def seeded_hash(seed: object, *ids: Column) -> Column:
    """Hex digest that orders rows the same way on every cluster size."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_int(digest: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative long: remainders reach every row of any table."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    digest: Column,
    tie: Column,
    by: Sequence[str] = (),
    name: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Number the rows 1..n per group in digest order.

    A window over the whole group would sort a hot label in one task. The digest
    is uniform, so its leading digits cut every group into equal buckets: rows are
    numbered inside a bucket and shifted by the rows in the buckets before it.
    """
    by = list(by)
    keyed = df.withColumn("_digest", digest).withColumn("_tie", tie)
    keyed = keyed.withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_bucket").alias("_in"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_digest", "_tie")
    condition = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    condition.append(F.col("_bucket") == F.col("_in"))
    joined = keyed.join(shifts, condition, "inner").drop("_in", *[f"_by_{c}" for c in by])
    return joined.withColumn(
        name, (F.col("_shift") + F.row_number().over(inside)).cast("bigint")
    ).drop("_digest", "_tie", "_bucket", "_shift")


def position_rows(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based row number in a declared order, from one range-partitioned sort.

    The sorted rows are written once, so the partition layout that the numbers
    rest on cannot change on a retry; the offsets are one row per partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stable = cut_lineage(spread.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", ROW_BITS)
    sizes = stable.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        stable.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + local)
        .drop("_mid", "_part", "_shift")
    )


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """Exact values at 0-based ``ranks`` of a double column.

    Each pass counts at most BINS bins inside the interval that still holds the
    rank; nothing larger than one bin table reaches the driver. Nulls are left out; a value
    that is not finite is an error.
    """
    bins = 2048
    out = []
    base = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    for rank in ranks:
        low, high, skipped = None, None, 0
        while True:
            part = base
            if low is None:
                edge = part.agg(F.min("v"), F.max("v")).first()
                low, high = edge[0], edge[1]
                if not (math.isfinite(low) and math.isfinite(high)):  # NaN counts as the largest value
                    raise ValueError(f"{value} holds values that are not finite")
            part = part.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
            width = high / bins - low / bins
            # Where the width underflows, fewer than BINS different values are left.
            slot = (
                F.least(
                    F.floor(F.col("v") / F.lit(width) - F.lit(low / width)), F.lit(bins - 1)
                ).cast("int")
                if width > 0 and math.isinf(high - low)
                else F.least(
                    F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)
                ).cast("int")
                if width > 0
                else F.col("v")
            )
            table = (
                part.groupBy(slot.alias("slot"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("slot")
                .collect()
            )
            seen = skipped
            for row in table:
                if seen + row["n"] > rank:
                    break
                seen += row["n"]
            low, high, skipped = row["lo"], row["hi"], seen
            if low == high:
                out.append(low)
                break
            if rank == seen:
                out.append(low)
                break
            if rank == seen + row["n"] - 1:
                out.append(high)
                break
    return out


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], infinite: bool = False
) -> list[float]:
    """Linearly interpolated percentiles of a column (numpy's default rule).

    With ``infinite``, infinities count as rows below or above all others, and only a percentile
    that rests on one of them is an error.
    """
    known_rows = df.where(F.col(value).isNotNull())
    n, below, above = known_rows.agg(
        F.count(F.lit(1)),
        F.count_if(F.col(value).cast("double") == float("-inf")),
        F.count_if(F.col(value).cast("double") == float("inf")),
    ).first()
    if n == 0:
        raise ValueError(f"no values in {value}")
    places = [p * (n - 1) for p in probabilities]
    needed = sorted({math.floor(x) for x in places} | {math.ceil(x) for x in places})
    if not infinite:
        below = above = 0
    elif needed[0] < below or needed[-1] >= n - above:
        raise ValueError(f"percentiles of {value} rest on values that are not finite")
    else:
        df = df.where(~F.col(value).cast("double").isin(float("-inf"), float("inf")))
    found = order_statistics(df, value, [i - below for i in needed])
    known = dict(zip(needed, found))
    out = []
    for place in places:
        lo, hi = known[math.floor(place)], known[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out
