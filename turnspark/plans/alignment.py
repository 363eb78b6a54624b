"""From raw trials to class labels: filter, cut, align, classify, vote."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.functions.filters import band_without_hum
from turnspark.models import linear, riemann, spatial
from turnspark.operators import ensemble as en
from turnspark.operators import metrics as m
from turnspark.operators import trials as tr

KEYS = ["subject", "trial", "y"]

#: A step over the trials before windows are cut: filters, cropping, scaling.
Prepare = Callable[[DataFrame], DataFrame]


def aligned_windows(
    trials: DataFrame, size: int, stride: int, prepare: Prepare | None = None
) -> DataFrame:
    """Window covariances of (optionally prepared) trials, aligned per subject.

    A subject is aligned with its own windows only, so test subjects need no labels.
    """
    signal = prepare(trials) if prepare else trials
    return tr.align_by_subject(tr.window_covariances(signal, size, stride))


def vote(probs: DataFrame, n_classes: int) -> DataFrame:
    """Mean over the windows of a trial and the winning class as ``pred``."""
    return en.soft_vote(probs, KEYS, n_classes).withColumnRenamed("label", "pred")


def align_and_classify(
    train: DataFrame,
    test: DataFrame,
    size: int,
    stride: int,
    n_classes: int,
    c: float = 0.1,
    prepare: Prepare | None = None,
) -> DataFrame:
    """Tangent-space logistic regression on aligned windows; one row per test trial."""
    fitted = aligned_windows(train, size, stride, prepare)
    reference = riemann.karcher_mean(fitted)
    model = linear.fit_multinomial(
        riemann.tangent_features(fitted, reference), c=c, label="y"
    )
    held = riemann.tangent_features(aligned_windows(test, size, stride, prepare), reference)
    return vote(linear.logistic_probs(held, model), n_classes)


def signal_windows(
    trials: DataFrame,
    size: int,
    stride: int,
    score: Callable[[DataFrame], DataFrame],
    n_classes: int,
    prepare: Prepare | None = None,
) -> DataFrame:
    """Raw-signal variant: whiten per subject, cut, scale each window, score, vote.

    ``score`` adds ``probs`` to the windows, for example a ``mapInPandas`` around an
    external model.
    """
    from turnspark.functions.signals import zscore_rows

    signal = prepare(trials) if prepare else trials
    white = tr.whiten_by_subject(signal, tr.whitening_by_subject(signal))
    windows = tr.sliding_windows(white, size, stride)
    return vote(score(windows.withColumn("x", zscore_rows(F.col("x")))), n_classes)


def leave_one_subject_out_mdm(
    trials: DataFrame, size: int, stride: int, classes: Sequence[int], subjects: Sequence[int]
) -> DataFrame:
    """Minimum distance to mean for every held-out subject at once; one row per trial."""
    covs = aligned_windows(trials, size, stride)
    means = riemann.karcher_means(covs, "y", classes, "subject", subjects)
    return vote(riemann.mdm_probs(covs, means, classes, "subject"), len(classes))


def band_sweep(
    trials: DataFrame,
    bands: Mapping[str, tuple[float, float]],
    fs: float,
    fit_and_score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The same workflow per frequency band, ranked by accuracy.

    ``fit_and_score`` takes filtered trials and returns rows with y and pred.
    """
    results = None
    for name, (low, high) in bands.items():
        scored = fit_and_score(tr.filter_signals(trials, band_without_hum(low, high, fs)))
        part = m.accuracy(scored, (), "y", "pred").withColumn("name", F.lit(name))
        results = part if results is None else results.unionByName(part)
    return en.leaderboard(results, "accuracy")


def csp_lda_probs(
    train: DataFrame, test: DataFrame, size: int, stride: int, n_filters: int = 6
) -> DataFrame:
    """Log power of common spatial patterns, shrinkage discriminant, softmax scores."""
    from turnspark.functions.scores import softmax

    covs = tr.window_covariances(train, size, stride)
    rows = spatial.csp_filters(*spatial.mean_class_covariances(covs, "y"), n_filters)
    model = linear.fit_lda(spatial.csp_features(covs, rows), "y")
    held = spatial.csp_features(tr.window_covariances(test, size, stride), rows)
    return model.decide(held).withColumn("probs", softmax(F.col("scores"))).drop("scores")


def csp_ridge_votes(
    train: DataFrame, test: DataFrame, size: int, stride: int, n_filters: int = 4
) -> DataFrame:
    """Regularised common spatial patterns and ridge; decision values are averaged."""
    windows = tr.sliding_windows(train, size, stride)
    shaped = spatial.class_covariances(windows, "y", "ledoit_wolf")
    rows = spatial.csp_filters(*shaped, n_filters)
    powers = tr.window_covariances(train, size, stride, "second_moment")
    model = linear.fit_ridge(spatial.csp_features(powers, rows), "y")
    held = tr.window_covariances(test, size, stride, "second_moment")
    scored = model.decide(spatial.csp_features(held, rows)).withColumnRenamed("scores", "probs")
    return vote(scored, len(model.classes))


def xdawn_probs(
    train: DataFrame, test: DataFrame, size: int, stride: int, n_filters: int = 4, c: float = 1.0
) -> DataFrame:
    """xDAWN covariances, tangent space, logistic regression."""
    windows = tr.sliding_windows(train, size, stride)
    model = spatial.fit_xdawn(windows, "y", n_filters)
    covs = spatial.xdawn_covariances(windows, model)
    reference = riemann.karcher_mean(covs)
    fitted = linear.fit_multinomial(riemann.tangent_features(covs, reference), c=c, label="y")
    held = spatial.xdawn_covariances(tr.sliding_windows(test, size, stride), model)
    return linear.logistic_probs(riemann.tangent_features(held, reference), fitted)
