"""Multichannel trials: windows, covariances, alignment and filters.

A trial table has key columns and ``x`` as channels x time. Matrices are flat
row-major arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.functions import filters, signals
from turnspark.functions.matrices import block_stage, flat, mean_arrays, spectral, square
from turnspark.skew import lookup_join

EIGEN_FLOOR = 1e-6


def _others(df: DataFrame, *dropped: str) -> list[str]:
    return [c for c in df.columns if c not in dropped]


def _flattened(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("_channels", F.size(x)).withColumn(
        "_x", F.flatten(F.col(x).cast("array<array<double>>"))
    )


def _signals(block: dict) -> np.ndarray:
    """(N, C, T) from the flattened block; all rows of a block have the same length."""
    channels = int(block["_channels"][0])
    return block["_x"].reshape(len(block["_x"]), channels, -1)


def _nested(flat_x: Column, channels: Column) -> Column:
    samples = (F.size(flat_x) / channels).cast("int")
    return F.transform(
        F.sequence(F.lit(0), channels - 1), lambda c: F.slice(flat_x, c * samples + 1, samples)
    )


# ---------------------------------------------------------------- windows


def sliding_windows(df: DataFrame, size: int, stride: int, x: str = "x") -> DataFrame:
    """One row per window: the keys repeat, ``w`` counts and ``start`` is the first sample."""
    samples = F.size(F.get(x, 0))
    checked = F.when(
        samples >= size, F.sequence(F.lit(0), samples - size, F.lit(stride))
    ).otherwise(
        F.raise_error(F.lit(f"window of {size} is longer than the trial")).cast("array<int>")
    )
    placed = df.select("*", F.posexplode(checked).alias("w", "start"))
    cut = F.transform(x, lambda ch: F.slice(ch, F.col("start") + 1, F.lit(size)))
    return placed.withColumn(x, cut)


# ---------------------------------------------------------------- covariances


def oas(samples: np.ndarray) -> np.ndarray:
    """Centred covariance of (..., C, T) with oracle-approximating shrinkage (Chen et al. 2010)."""
    size, n = samples.shape[-2], samples.shape[-1]
    centred = samples - samples.mean(axis=-1, keepdims=True)
    cov = centred @ np.swapaxes(centred, -1, -2) / n
    mu = np.trace(cov, axis1=-2, axis2=-1) / size
    alpha = (cov**2).mean(axis=(-2, -1))
    bottom = (n + 1.0) * (alpha - mu**2 / size)
    safe = np.where(bottom == 0, 1.0, bottom)
    rho = np.where(bottom == 0, 1.0, np.minimum(1.0, (alpha + mu**2) / safe))
    return (1 - rho)[..., None, None] * cov + (rho * mu)[..., None, None] * np.eye(size)


def raw_moment(samples: np.ndarray) -> np.ndarray:
    return samples @ np.swapaxes(samples, -1, -2) / samples.shape[-1]


def covariances(df: DataFrame, estimator: str = "oas", x: str = "x") -> DataFrame:
    """Replace ``x`` by ``cov``, the covariance (or second moment) of each row."""
    estimate = {"oas": oas, "second_moment": raw_moment}[estimator]
    keep = _others(df, x)

    def run(block):
        return {"cov": flat(estimate(_signals(block)))}

    return block_stage(_flattened(df, x), ["_x", "_channels"], {"cov": "array<double>"}, run, keep)


def window_covariances(
    df: DataFrame, size: int, stride: int, estimator: str = "oas", x: str = "x"
) -> DataFrame:
    """Covariances of all windows of each trial.

    Equals ``covariances(sliding_windows(...))``, but each trial crosses to Python once
    and the overlapping windows are only views there.
    """
    estimate = {"oas": oas, "second_moment": raw_moment}[estimator]
    keep = _others(df, x)

    def run(block):
        data = _signals(block)
        starts = np.array(signals.window_starts(data.shape[-1], size, stride))
        views = np.lib.stride_tricks.sliding_window_view(data, size, axis=-1)
        cov = np.stack([estimate(views[:, :, s, :]) for s in starts], axis=1)
        n, count = cov.shape[:2]
        return {
            "_row": np.repeat(np.arange(n), count),
            "w": np.tile(np.arange(count), n),
            "start": np.tile(starts, n),
            "cov": cov.reshape(n * count, -1),
        }

    outputs = {"w": "int", "start": "int", "cov": "array<double>"}
    return block_stage(
        _flattened(df, x), ["_x", "_channels"], outputs, run, keep, repeat=True
    )


def subject_reference(covs: DataFrame, subject: str = "subject", cov: str = "cov") -> DataFrame:
    """Mean matrix of every subject."""
    return mean_arrays(covs, [subject], cov, "ref").select(subject, "ref")


def inverse_roots(refs: DataFrame, subject: str = "subject", ref: str = "ref") -> DataFrame:
    """Symmetric inverse square root of every reference, eigenvalues floored."""

    def run(block):
        roots = spectral(square(block[ref]), lambda v: 1 / np.sqrt(np.maximum(v, EIGEN_FLOOR)))
        return {"whitening": flat(roots)}

    return block_stage(refs, [ref], {"whitening": "array<double>"}, run, [subject])


def align_covariances(
    covs: DataFrame,
    roots: DataFrame,
    subject: str = "subject",
    cov: str = "cov",
    spread_by: Sequence[str] = ("trial", "w"),
) -> DataFrame:
    """R^-1/2 C R^-1/2 with the subject's own reference."""
    joined = lookup_join(covs, roots, [subject], spread_by)

    def run(block):
        root = square(block["whitening"])
        return {cov: flat(root @ square(block[cov]) @ root)}

    return block_stage(
        joined, [cov, "whitening"], {cov: "array<double>"}, run, _others(covs, cov)
    )


def align_by_subject(
    covs: DataFrame, subject: str = "subject", spread_by: Sequence[str] = ("trial", "w")
) -> DataFrame:
    """Align every subject to its own mean, which then becomes the identity."""
    roots = inverse_roots(subject_reference(covs, subject), subject)
    return align_covariances(covs, roots, subject, spread_by=spread_by)


def whitening_by_subject(df: DataFrame, subject: str = "subject") -> DataFrame:
    """Whitening matrix of every subject from the raw second moments of its trials."""
    moments = covariances(df, "second_moment")
    return inverse_roots(subject_reference(moments, subject), subject)


def whiten_by_subject(
    df: DataFrame,
    roots: DataFrame,
    subject: str = "subject",
    x: str = "x",
    spread_by: Sequence[str] = ("trial",),
) -> DataFrame:
    """Multiply every trial by its subject's whitening matrix."""
    joined = lookup_join(df, roots, [subject], spread_by)
    keep = _others(df, x)

    def run(block):
        return {"_y": flat(square(block["whitening"]) @ _signals(block))}

    out = block_stage(
        _flattened(joined, x),
        ["_x", "_channels", "whitening"],
        {"_y": "array<double>"},
        run,
        [*keep, "_channels"],
    )
    return out.withColumn(x, _nested(F.col("_y"), F.col("_channels"))).drop("_y", "_channels")


# ---------------------------------------------------------------- scaling


def zscore_subject(
    df: DataFrame,
    subject: str = "subject",
    x: str = "x",
    eps: float = 1e-6,
    spread_by: Sequence[str] = ("trial",),
) -> DataFrame:
    """Scale each channel by its mean and deviation over all trials of the subject.

    The variance is that within the trials plus that of the trials' means, both centred, so
    signals far from zero keep their digits.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    channel = df.select(subject, F.posexplode(x).alias("ch", "v")).select(
        subject, "ch", F.size("v").alias("n"), signals.mean_of(F.col("v")).alias("m"), "v"
    )
    parts = channel.select(
        subject, "ch", "n", "m", (signals.deviation_of(F.col("v"), F.col("m")) ** 2).alias("var")
    )
    n = F.sum("n")
    weighted = Summarizer.metrics("mean", "variance").summary(
        array_to_vector(F.array("m")), F.col("n").cast("double")
    )
    sums = parts.groupBy(subject, "ch").agg(
        weighted.alias("s"),
        (F.sum(F.col("n") * F.col("var")) / n).alias("within"),
        # The summary divides by the weights less their mean weight; here it is by all weights.
        (1.0 - F.sum(F.col("n") * F.col("n")) / (n * n)).alias("share"),
    )
    between = F.get(vector_to_array("s.variance"), 0) * F.col("share")
    per_channel = sums.select(
        subject,
        "ch",
        F.get(vector_to_array("s.mean"), 0).alias("mean"),
        F.sqrt(F.col("within") + between).alias("sd"),
    )
    stats = per_channel.groupBy(subject).agg(
        F.array_sort(F.collect_list(F.struct("ch", "mean", "sd"))).alias("_stats")
    )
    joined = lookup_join(df, stats, [subject], spread_by)
    scaled = F.zip_with(
        x,
        "_stats",
        lambda ch, s: F.transform(ch, lambda v: (v - s["mean"]) / (s["sd"] + F.lit(eps))),
    )
    return joined.withColumn(x, scaled).drop("_stats")


# ---------------------------------------------------------------- filters


def filter_signals(df: DataFrame, designs: Sequence[tuple], x: str = "x") -> DataFrame:
    """Every channel through the (b, a) ``designs`` in turn, without phase shift, in one pass.

    Designs come from ``turnspark.functions.filters``; cropping and scaling are steps of their own.
    """
    keep = _others(df, x)

    def run(block):
        data = _signals(block)
        rows = data.reshape(-1, data.shape[-1])
        for b, a in designs:
            rows = filters.zero_phase(b, a, rows)
        return {"_y": rows.reshape(len(data), -1)}

    out = block_stage(
        _flattened(df, x), ["_x", "_channels"], {"_y": "array<double>"}, run, [*keep, "_channels"]
    )
    return out.withColumn(x, _nested(F.col("_y"), F.col("_channels"))).drop("_y", "_channels")


# ---------------------------------------------------------------- profile


def profile_trials(df: DataFrame, classes: Sequence[int], subject: str = "subject") -> DataFrame:
    """Trials, channel and sample ranges and class counts per subject."""
    channels, samples = F.size("x"), F.size(F.get("x", 0))
    return df.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.min(channels).alias("min_channels"),
        F.max(channels).alias("max_channels"),
        F.min(samples).alias("min_samples"),
        F.max(samples).alias("max_samples"),
        *[F.count_if(F.col("y") == c).alias(f"class{c}") for c in classes],
    )


def pooled_token_vectors(
    tokens: DataFrame, row_id: str = "id", pos: str = "pos", vector: str = "vector"
) -> DataFrame:
    """First token vector followed by the mean of the unmasked ones.

    ``tokens`` has one row per token with an integer ``mask``; sums and counts combine
    map-side, however long a text is.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    masked = F.transform(vector, lambda v: v * F.col("mask"))
    pooled = tokens.groupBy(row_id).agg(
        F.min_by(vector, pos).alias("first"),
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("total"),
        F.greatest(F.sum("mask"), F.lit(1)).alias("n"),
    )
    mean = F.transform("total", lambda v: v / F.col("n"))
    return pooled.select(row_id, F.concat("first", mean).alias("pooled"))
