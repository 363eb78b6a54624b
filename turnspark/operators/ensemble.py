"""Combining models and choosing among results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnspark.functions.scores import argmax_label, confidence


GATE_BROADCAST = 100_000  # gated rows (an id and a flag each) up to which they are sent to all tasks


def mean_probs(probs: str, n_classes: int) -> Column:
    """Element-wise mean of a probability array, as an aggregate."""
    return F.array(*[F.avg(F.get(probs, i)) for i in range(n_classes)])


def soft_vote(
    windows: DataFrame, keys: Sequence[str], n_classes: int, probs: str = "probs"
) -> DataFrame:
    """Average the window scores of every trial, then take the best class."""
    voted = windows.groupBy(*keys).agg(
        mean_probs(probs, n_classes).alias("probs"), F.count(F.lit(1)).alias("n_windows")
    )
    return voted.withColumn("label", argmax_label(F.col("probs")))


def align_models(
    probs: DataFrame, models: Sequence[str], row_id: str = "id", value: str = "probs"
) -> DataFrame:
    """One row per id with the outputs of all ``models`` in order; a gap is an error."""
    wide = probs.groupBy(row_id).agg(
        *[
            F.max(F.when(F.col("model") == m, F.col(value))).alias(f"_m{i}")
            for i, m in enumerate(models)
        ],
        *[F.count_if(F.col("model") == m).alias(f"_n{i}") for i, m in enumerate(models)],
    )
    complete = F.lit(True)
    for i in range(len(models)):
        complete = complete & (F.col(f"_n{i}") == 1)
    stack = F.array(*[F.col(f"_m{i}") for i in range(len(models))])
    problem = F.raise_error(
        F.concat(F.lit("not exactly one output per model for id "), F.col(row_id).cast("string"))
    )
    return wide.select(
        row_id,
        F.when(complete, stack).otherwise(problem.cast(wide.select(stack).schema[0].dataType)).alias(
            "stack"
        ),
    )


def normalized_weights(models: Sequence[str], weights: Sequence[float] | None) -> list[float]:
    if weights is None:
        return [1.0 / len(models)] * len(models)
    if len(weights) != len(models):
        raise ValueError(f"{len(weights)} weights for {len(models)} models")
    total = float(sum(weights))
    return [float(w) / total for w in weights]


def ensemble_mean(
    probs: DataFrame,
    models: Sequence[str],
    n_classes: int,
    weights: Sequence[float] | None = None,
    row_id: str = "id",
) -> DataFrame:
    """Weighted mean of the models' probability arrays, with the resulting label."""
    shares = normalized_weights(models, weights)
    aligned = align_models(probs, models, row_id)

    def mixed(cls: int) -> Column:
        total = F.lit(0.0)
        for i, share in enumerate(shares):
            total = total + F.get(F.get("stack", i), cls) * F.lit(share)
        return total

    return aligned.select(
        row_id, F.array(*[mixed(c) for c in range(n_classes)]).alias("probs")
    ).withColumn("label", argmax_label(F.col("probs")))


def paired_outputs(
    strong: DataFrame,
    diverse: DataFrame,
    row_id: str = "id",
    probs: str = "probs",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Labels of both models and the strong model's confidence, one row per id."""
    a = strong.select(
        row_id,
        *keep,
        argmax_label(F.col(probs)).alias("strong_label"),
        confidence(F.col(probs)).alias("confidence"),
    )
    b = diverse.select(row_id, argmax_label(F.col(probs)).alias("diverse_label"))
    return a.join(b, row_id)


def least_confident(pairs: DataFrame, k: int, row_id: str = "id") -> DataFrame:
    """The k rows of lowest confidence with their rank, ties broken by id.

    Every task keeps k rows and one task merges them; k is the caller's small number of gated rows.
    """
    first = pairs.orderBy("confidence", row_id).limit(k)
    return first.withColumn("gate_rank", F.row_number().over(W.orderBy("confidence", row_id)).cast("bigint"))


def confidence_gate(pairs: DataFrame, k: int, row_id: str = "id") -> DataFrame:
    """Let the diverse model decide the k rows where the strong model is least sure."""
    gated = pairs.orderBy("confidence", row_id).limit(k).select(row_id, F.lit(True).alias("gated"))
    joined = pairs.join(F.broadcast(gated) if k <= GATE_BROADCAST else gated, row_id, "left")
    is_gated = F.coalesce(F.col("gated"), F.lit(False))
    label = F.when(is_gated, F.col("diverse_label")).otherwise(F.col("strong_label"))
    return joined.select(
        *pairs.columns,
        is_gated.alias("gated"),
        label.alias("label"),
        (label != F.col("strong_label")).alias("changed"),
    )


def gate_sweep(
    pairs: DataFrame, ks: Sequence[int], row_id: str = "id", truth: str = "y"
) -> DataFrame:
    """Changed labels and accuracy for several k from one ranking.

    Only the gated rows can differ from the strong model, so the whole table is read
    once for its size and hits and every k adds a correction from the ranked rows.
    """
    ranked = least_confident(pairs, max(ks), row_id)
    base = pairs.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("strong_label") == F.col(truth)).alias("hits"),
        ).alias("b")
    ).scalar()
    swap = (F.col("diverse_label") == F.col(truth)).cast("int") - (
        F.col("strong_label") == F.col(truth)
    ).cast("int")
    per_k = [
        F.struct(
            F.lit(int(k)).alias("k"),
            F.count_if((F.col("gate_rank") <= k)).alias("gated"),
            F.count_if(
                (F.col("gate_rank") <= k) & (F.col("strong_label") != F.col("diverse_label"))
            ).alias("changed"),
            F.coalesce(F.sum(F.when(F.col("gate_rank") <= k, swap)), F.lit(0)).alias("gain"),
        ).alias(f"k{i}")
        for i, k in enumerate(ks)
    ]
    rows = ranked.agg(*per_k).select(
        F.explode(F.array(*[f"k{i}" for i in range(len(ks))])).alias("e")
    )
    return rows.select(
        "e.k",
        "e.gated",
        "e.changed",
        ((base["hits"] + F.col("e.gain")) / base["n"]).alias("accuracy"),
    )


def topk_per_row(
    sim: DataFrame, k: int, row: str, other: str, score: str = "similarity"
) -> DataFrame:
    """The k most similar partners of every row; ties go to the larger partner key."""
    order = W.partitionBy(row).orderBy(F.desc(score), F.desc(other))
    return sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _moments(score: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mu"),
        F.coalesce(F.var_pop(score), F.lit(0.0)).alias("var"),
    ]


def _apply_zscores(
    scores: DataFrame,
    stats: DataFrame,
    weights: Mapping[str, float],
    keys: Sequence[str],
    row_id: str,
    fold: str,
    score: str,
) -> DataFrame:
    """Standardise with one (mu, var) per key; there are only models x folds keys."""

    def key() -> Column:
        return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys])

    lookup = stats.select(key().alias("k"), F.struct("mu", "var").alias("v")).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v")))
    )
    own = F.element_at(lookup.scalar(), key())
    share = F.lit(0.0)
    for model, weight in weights.items():
        share = F.when(F.col("model") == model, F.lit(float(weight))).otherwise(share)
    z = (F.col(score) - own["mu"]) / (F.sqrt(own["var"]) + F.lit(1e-12))
    return (
        scores.where(F.col("model").isin(list(weights)))
        .withColumn("_wz", share * z)
        .groupBy(row_id, fold)
        .agg(F.sum("_wz").alias("combined"))
        .withColumn("pred", (F.col("combined") > 0).cast("int"))
    )


def score_zscore_ensemble(
    scores: DataFrame,
    weights: Mapping[str, float],
    row_id: str = "id",
    fold: str = "fold",
    score: str = "score",
) -> DataFrame:
    """Weighted sum of held-out scores, standardised per (model, fold) on the training rows.

    ``scores`` has model, fold, id, split (train or valid) and score: every fold's model
    scores its own training rows as well.
    """
    train = scores.where(F.col("split") == "train").groupBy("model", fold).agg(*_moments(score))
    held = scores.where(F.col("split") == "valid")
    return _apply_zscores(held, train, weights, ["model", fold], row_id, fold, score)


def complement_moments(df: DataFrame, score: str, fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and population variance of all rows outside each fold.

    Moments are additive: what is left after taking a fold out of the total needs no
    second pass over the rows, so one aggregation serves all folds.
    """
    parts = df.groupBy(*by, fold).agg(*_moments(score))
    whole = W.partitionBy(*by)
    n, mu, var = F.col("n"), F.col("mu"), F.col("var")
    total_n = F.sum("n").over(whole)
    parts = parts.withColumn("_n", total_n).withColumn(
        "_mu", F.sum(n * mu).over(whole) / total_n
    )
    centred = n * (var + (mu - F.col("_mu")) ** 2)
    parts = parts.withColumn("_m2", F.sum(centred).over(whole))
    rest = F.col("_n") - n
    rest_mu = (F.col("_n") * F.col("_mu") - n * mu) / rest
    rest_m2 = F.col("_m2") - n * var - n * (mu - F.col("_mu")) ** 2
    rest_var = rest_m2 / rest - (rest_mu - F.col("_mu")) ** 2
    return parts.select(
        *by, fold, rest.alias("n"), rest_mu.alias("mu"), F.greatest(rest_var, F.lit(0.0)).alias("var")
    )


def zscore_ensemble_fixed(
    scores: DataFrame,
    weights: Mapping[str, float],
    row_id: str = "id",
    fold: str = "fold",
    score: str = "score",
) -> DataFrame:
    """As :func:`score_zscore_ensemble` for models that do not depend on the fold.

    ``scores`` then has one row per (model, id) and the training moments of a fold are
    those of its complement.
    """
    train = complement_moments(scores, score, fold, ["model"])
    return _apply_zscores(scores, train, weights, ["model", fold], row_id, fold, score)


def mean_threshold(members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of an ensemble whose members were tuned on different splits."""
    return members.groupBy(*by).agg(F.avg("threshold").alias("threshold"))


def leaderboard(results: DataFrame, metric: str, name: str = "name") -> DataFrame:
    """Results (one row per config) from best to worst, ties by name."""
    order = W.orderBy(F.desc_nulls_last(metric), F.col(name))
    return results.withColumn("place", F.row_number().over(order))


def best_of_kind(results: DataFrame, metric: str, kind: str, name: str = "name") -> DataFrame:
    """The best config of every kind."""
    order = W.partitionBy(kind).orderBy(F.desc_nulls_last(metric), F.col(name))
    return results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_epoch(
    history: DataFrame, metric: str, epoch: str = "epoch", by: Sequence[str] = ()
) -> DataFrame:
    """The earliest epoch that reaches the best value of the metric."""
    best = F.max_by(
        F.struct(F.col(epoch).alias("epoch"), F.col(metric).alias("value")),
        F.struct(F.col(metric).alias("a"), (-F.col(epoch)).alias("b")),
    )
    return history.groupBy(*by).agg(best.alias("best")).select(
        *by, F.col("best.epoch").alias("epoch"), F.col("best.value").alias(metric)
    )


def best_candidate(
    candidates: DataFrame, preferred: str, metric: str, name: str = "name", order: str = "pos"
) -> DataFrame:
    """The preferred candidate when present, else the best scored one; null scores lose."""
    is_preferred = (F.col(name) == preferred).cast("int")
    return candidates.orderBy(
        F.desc(is_preferred), F.desc_nulls_last(metric), F.col(order)
    ).limit(1)


def ensemble_specs(members: DataFrame, pair: tuple[int, int] = (42, 13)) -> DataFrame:
    """Member sets to average: the fixed pair, top two, top three and all seeds.

    ``members`` has one row per seed with its tuned score. A set seen before is dropped.
    """
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("seed").alias("seed")))
    )
    seeds = members.agg(F.transform(ranked, lambda e: e["seed"]).alias("seeds"))
    n = F.size("seeds")
    a, b = F.lit(pair[0]), F.lit(pair[1])
    has_pair = F.array_contains("seeds", a) & F.array_contains("seeds", b)

    def spec(order: int, name: str, chosen: Column, ok: Column) -> Column:
        return F.when(
            ok,
            F.struct(F.lit(order).alias("spec"), F.lit(name).alias("name"), chosen.alias("members")),
        )

    options = F.array(
        spec(0, "pair_average", F.array(a, b).cast("array<int>"), has_pair),
        spec(1, "top2_average", F.slice("seeds", 1, 2), n >= 2),
        spec(2, "top3_average", F.slice("seeds", 1, 3), n >= 3),
        spec(3, "all_average", F.col("seeds"), n >= 2),
    )
    rows = seeds.select(F.explode(F.array_compact(options)).alias("e")).select("e.*")
    first = W.partitionBy(F.array_sort("members")).orderBy("spec")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
