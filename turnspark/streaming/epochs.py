"""Events cut into trials. The same functions take a batch table and a stream.

On a stream, rows later than the watermark are dropped and a window is emitted once the watermark
passes its end (append mode); on a batch table the watermark has no effect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(28,6)"  # sums in it do not depend on the order of the rows


def timed_events(events: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with its watermark; rows without one are left out."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    return stamped.withWatermark(ts, late)


def _bin_sum(value: str, hit: Column) -> Column:
    return F.coalesce(F.sum(F.when(hit, F.col(value).cast(EXACT))), F.lit(0).cast(EXACT)).cast("double")


def epoch_events(
    events: DataFrame,
    channels: Sequence[str],
    size: int,
    bins: int,
    slide: int | None = None,
    late: str = "1 hour",
    subject: str = "user_id",
    channel: str = "event_type",
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Trials (subject, start, n, x) of ``size`` seconds, one every ``slide`` seconds.

    x is channels x bins: the sum of the values of one channel in one of ``bins`` equal parts of
    the window. Windows without an event have no row, events of other channels count in n only, null
    values add nothing. One aggregation with map-side sums; a hot subject is combined before the
    shuffle.
    """
    step = slide or size
    if size % bins or size % step:
        raise ValueError("bins and slide must divide the size")
    width = size // bins
    span = F.window(ts, f"{size} seconds", f"{step} seconds")
    seconds = F.unix_micros(ts) - F.unix_micros(F.col("_span.start"))
    placed = (
        timed_events(events, late, ts)
        .withColumn("_span", span)
        .withColumn("_bin", F.floor(seconds / F.lit(width * 1_000_000)).cast("int"))
    )
    sums = [
        _bin_sum(value, (F.col(channel) == c) & (F.col("_bin") == b)).alias(f"_x{i}_{b}")
        for i, c in enumerate(channels)
        for b in range(bins)
    ]
    windows = placed.groupBy(subject, "_span").agg(F.count(F.lit(1)).alias("n"), *sums)
    x = F.array(
        *[F.array(*[F.col(f"_x{i}_{b}") for b in range(bins)]) for i in range(len(channels))]
    )
    return windows.select(
        F.col(subject).alias("subject"), F.col("_span.start").alias("start"), "n", x.alias("x")
    )


def sessions(
    events: DataFrame,
    gap: int,
    late: str = "1 hour",
    subject: str = "user_id",
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Runs of a subject's events with at most ``gap`` seconds between neighbours.

    Rows are (subject, first, last, n, total); null values add nothing to the total.
    """
    runs = timed_events(events, late, ts).groupBy(subject, F.session_window(ts, f"{gap} seconds").alias("_run"))
    rows = runs.agg(
        F.max(ts).alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(value).cast(EXACT)), F.lit(0).cast(EXACT)).cast("double").alias("total"),
    )
    return rows.select(
        F.col(subject).alias("subject"), F.col("_run.start").alias("first"), "last", "n", "total"
    )
