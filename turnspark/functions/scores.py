"""Score and probability columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnspark.functions.binding import bind


def labels_from_scores(score: Column, threshold: Column | float, strict: bool = False) -> Column:
    """1 where the score reaches (or, when strict, exceeds) the threshold."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return ((score > cut) if strict else (score >= cut)).cast("int")


def confidence(probs: Column) -> Column:
    """Largest entry of a probability array."""
    return F.array_max(probs)


def argmax_label(probs: Column) -> Column:
    """0-based index of the first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def margin(prob: Column, threshold: Column | float) -> Column:
    """Distance of a probability from its threshold."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.abs(prob - cut)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    """Row-wise softmax, shifted by the largest logit."""

    def raised(z: Column) -> Column:
        return bind(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    def shares(e: Column) -> Column:
        return bind(array_sum(e), lambda total: F.transform(e, lambda v: v / total))

    return bind(logits, lambda z: bind(raised(z), shares))


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def logit(prob: Column) -> Column:
    """Log odds of a probability: infinite at 0 and 1."""
    ends = F.when(prob == 0, F.lit(float("-inf"))).when(prob == 1, F.lit(float("inf")))
    return ends.otherwise(F.log(prob / (1 - prob)))


def linear_score(columns: list[Column], weights: list[float], intercept: float) -> Column:
    """Fixed linear combination, added from left to right."""
    total = F.lit(float(intercept))
    for column, weight in zip(columns, weights, strict=True):
        total = total + column * F.lit(float(weight))
    return total


def binary_score(model_output: Column) -> Column:
    """Class 1 of a two-class output vector: the signed decision value of a raw prediction,
    the probability of class 1 of a probability vector."""
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(model_output), 1)
