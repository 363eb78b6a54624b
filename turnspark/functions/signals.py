"""Nested signal columns, channels x time as array<array<double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnspark.functions.binding import bind
from turnspark.functions.scores import array_sum


def crop(x: Column, start: int, end: int) -> Column:
    """Samples start..end of every channel, clamped so that one sample always stays."""

    def cut(channel: Column) -> Column:
        n = F.size(channel)
        first = F.greatest(F.lit(0), F.least(F.lit(start), n))
        stop = F.greatest(first + 1, F.least(F.lit(end), n))
        return F.slice(channel, first + 1, stop - first)

    return F.transform(x, cut)


def mean_of(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def deviation_of(values: Column, mean: Column) -> Column:
    """Population standard deviation."""
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.sqrt(squares / F.size(values))


def zscore_rows(x: Column, eps: float = 1e-6) -> Column:
    """Centre and scale every channel of one trial or window by its own statistics."""

    def scale(channel: Column) -> Column:
        def centred(mean: Column) -> Column:
            spread = deviation_of(channel, mean) + F.lit(eps)
            return bind(spread, lambda s: F.transform(channel, lambda v: (v - mean) / s))

        return bind(mean_of(channel), centred)

    return F.transform(x, scale)


def window_starts(samples: int, size: int, stride: int) -> list[int]:
    if size > samples:
        raise ValueError(f"window {size} is longer than the {samples} samples")
    return list(range(0, samples - size + 1, stride))
