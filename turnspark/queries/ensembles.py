"""Voting, gating and choosing among models."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspark.lineage import cut_lineage
from turnspark.operators import ensemble as en
from turnspark.operators import metrics as m
from turnspark.operators.splits import stratified_holdout, stratified_kfold
from turnspark.operators import thresholds as th
from turnspark.queries import views as v
from turnspark.queries.metrics import PROB_GRID, sql_class_scores, sql_sweep
from turnspark.queries.registry import query

PROBS = v.SQL_MODELS
MODELS = v.MODELS
BEST = "arg_max(cls, (p, -cls))"


@query(
    "soft_vote",
    f"""WITH {PROBS}, voted AS (SELECT id, cls, avg(p) AS p FROM probs GROUP BY id, cls)
        SELECT id, CAST(arg_max(cls, (round(p, 9), -cls)) AS INT) AS label,
               round(max(p), 8) AS top, 4::BIGINT AS n_windows FROM voted GROUP BY id""",
)
def soft_vote_query(spark, sf_dir):
    voted = en.soft_vote(v.model_probs(spark, sf_dir), ["id"], v.CLASSES)
    return voted.select("id", "label", F.round(F.array_max("probs"), 8).alias("top"), "n_windows")


@query(
    "align_models",
    f"""WITH {PROBS} SELECT id, count(DISTINCT model) AS n_models,
        count(*) // count(DISTINCT model) AS n_classes,
        round(sum(p) FILTER (cls = 0), 6) AS class0 FROM probs GROUP BY id""",
)
def align_query(spark, sf_dir):
    aligned = en.align_models(v.model_probs(spark, sf_dir), MODELS)
    return aligned.select(
        "id",
        F.size("stack").cast("bigint").alias("n_models"),
        F.size(F.get("stack", 0)).cast("bigint").alias("n_classes"),
        F.round(
            F.aggregate("stack", F.lit(0.0), lambda s, p: s + F.get(p, 0)), 6
        ).alias("class0"),
    )


@query(
    "ensemble_mean",
    f"""WITH {PROBS}, w AS (SELECT unnest(['strong', 'diverse1', 'diverse2', 'diverse3']) AS model,
        unnest([2.0, 1.0, 0.5, 0.5])::DOUBLE / 4 AS w),
    mixed AS (SELECT id, cls, sum(p * w) AS p FROM probs JOIN w USING (model) GROUP BY id, cls)
    SELECT id, CAST(arg_max(cls, (round(p, 9), -cls)) AS INT) AS label, round(max(p), 9) AS top,
           round(sum(p), 5) AS total FROM mixed GROUP BY id""",
)
def ensemble_query(spark, sf_dir):
    mean = en.ensemble_mean(
        v.model_probs(spark, sf_dir), MODELS, v.CLASSES, [2.0, 1.0, 0.5, 0.5]
    )
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    return mean.select(
        "id",
        "label",
        F.round(F.array_max("probs"), 9).alias("top"),
        F.round(total, 5).alias("total"),
    )


GATED = """ranked AS (SELECT *, row_number() OVER (ORDER BY confidence, id) AS r FROM pairs)"""


@query(
    "confidence_gate",
    f"""WITH {v.SQL_PAIRS}, {GATED} SELECT id, confidence, CAST(strong_label AS INT) AS strong_label,
        CAST(diverse_label AS INT) AS diverse_label, r <= 14 AS gated,
        CAST(CASE WHEN r <= 14 THEN diverse_label ELSE strong_label END AS INT) AS label,
        r <= 14 AND diverse_label <> strong_label AS changed FROM ranked""",
)
def gate_query(spark, sf_dir):
    return en.confidence_gate(v.gate_pairs(spark, sf_dir), 14).drop("y")


@query(
    "gate_sweep",
    f"""WITH {v.SQL_PAIRS}, {GATED}, ks AS (SELECT unnest([3, 5, 7, 10, 14]) AS k)
    SELECT k, count(*) FILTER (r <= k) AS gated,
      count(*) FILTER (r <= k AND strong_label <> diverse_label) AS changed,
      round(avg((CASE WHEN r <= k THEN diverse_label ELSE strong_label END = y)::INT), 6) AS accuracy
    FROM ranked CROSS JOIN ks GROUP BY k""",
)
def gate_sweep_query(spark, sf_dir):
    out = en.gate_sweep(v.gate_pairs(spark, sf_dir), [3, 5, 7, 10, 14])
    return out.select("k", "gated", "changed", F.round("accuracy", 6).alias("accuracy"))


@query(
    "topk_per_row",
    f"""WITH {v.SQL_STRONG}, r AS (SELECT id, cls, p,
        row_number() OVER (PARTITION BY id ORDER BY p DESC, cls DESC) AS rank FROM strong)
        SELECT id, CAST(cls AS INT) AS cls, p AS similarity, rank FROM r WHERE rank <= 5""",
)
def topk_query(spark, sf_dir):
    sim = v.strong_probs(spark, sf_dir).select(
        "id", F.posexplode("probs").alias("cls", "similarity")
    )
    return en.topk_per_row(sim, 5, "id", "cls")


def member_scores(spark, sf_dir):
    """(model, fold, id, label, score): two fixed scorers on the labelled turns."""
    folds = stratified_kfold(v.labelled_scores(spark, sf_dir), v.FOLDS, v.SEED)
    each = F.array(
        F.struct(F.lit("full").alias("model"), F.col("prob").alias("score")),
        F.struct(F.lit("short").alias("model"), F.col("prob_short").alias("score")),
    )
    rows = folds.select("id", "label", "fold", F.explode(each).alias("e")).select(
        "id", "label", "fold", "e.*"
    )
    return cut_lineage(rows)  # score tables are stored tables


SQL_MEMBERS = f"""folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5('{v.SEED}:' || id), id) - 1) % {v.FOLDS} AS INT) AS fold FROM labelled),
members AS (SELECT id, label, fold, 'full' AS model, prob AS score FROM folded
            UNION ALL SELECT id, label, fold, 'short', prob_short FROM folded)"""

SQL_ZSCORED = """held AS (SELECT DISTINCT fold AS f FROM members),
stats AS (SELECT model, f, avg(score) AS mu, stddev_pop(score) AS sd
          FROM members JOIN held ON fold <> f GROUP BY model, f),
w AS (SELECT 'full' AS model, 0.3::DOUBLE AS w UNION ALL SELECT 'short', 0.7::DOUBLE),
z AS (SELECT id, m.fold, sum(w * (score - mu) / (sd + 1e-12)) AS combined
      FROM members m JOIN stats s ON s.model = m.model AND s.f = m.fold JOIN w ON w.model = m.model
      GROUP BY id, m.fold)
SELECT id, fold, round(combined, 6) AS combined, (combined > 0)::INT AS pred FROM z"""


@query("score_zscore_ensemble", f"WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_ZSCORED}")
def zscore_query(spark, sf_dir):
    """Training rows of a fold are all rows of the other folds."""
    members = member_scores(spark, sf_dir)
    everywhere = members.withColumn(
        "held", F.explode(F.sequence(F.lit(0), F.lit(v.FOLDS - 1)))
    )
    split = F.when(F.col("fold") == F.col("held"), "valid").otherwise("train")
    scores = everywhere.withColumn("split", split).select(
        "model", F.col("held").alias("fold"), "id", "split", "score"
    )
    out = en.score_zscore_ensemble(scores, {"full": 0.3, "short": 0.7})
    return out.select("id", "fold", F.round("combined", 6).alias("combined"), "pred")


@query("zscore_ensemble_fixed", f"WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_ZSCORED}")
def zscore_fixed_query(spark, sf_dir):
    out = en.zscore_ensemble_fixed(member_scores(spark, sf_dir), {"full": 0.3, "short": 0.7})
    return out.select("id", "fold", F.round("combined", 6).alias("combined"), "pred")


SQL_FOLD_TUNED = (
    "s AS (SELECT model || fold AS k, id, label, score FROM members),"
    + sql_sweep("s", PROB_GRID, "k")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY macro_f1 DESC, threshold)
         AS r FROM swept), tuned AS (SELECT k, threshold, macro_f1 FROM ranked WHERE r = 1)"""
)


def tuned_members(spark, sf_dir):
    """One tuned threshold per (model, fold)."""
    keyed = member_scores(spark, sf_dir).withColumn(
        "k", F.concat("model", F.col("fold").cast("string"))
    )
    return th.tune_threshold_probs(keyed, by=["k"]).select("k", "threshold", "macro_f1")


@query(
    "mean_threshold",
    f"""WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_FOLD_TUNED}
        SELECT round(avg(threshold), 6) AS threshold FROM tuned""",
)
def mean_threshold_query(spark, sf_dir):
    out = en.mean_threshold(tuned_members(spark, sf_dir))
    return out.select(F.round("threshold", 6).alias("threshold"))


@query(
    "leaderboard",
    f"""WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_FOLD_TUNED}
        SELECT k AS name, round(macro_f1, 6) AS score, row_number() OVER
        (ORDER BY round(macro_f1, 6) DESC, k) AS place FROM tuned""",
)
def leaderboard_query(spark, sf_dir):
    results = tuned_members(spark, sf_dir).select(
        F.col("k").alias("name"), F.round("macro_f1", 6).alias("score")
    )
    return en.leaderboard(results, "score")


@query(
    "best_of_kind",
    f"""WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_FOLD_TUNED},
    n AS (SELECT k AS name, regexp_extract(k, '^[a-z]+') AS kind, round(macro_f1, 6) AS score
          FROM tuned), r AS (SELECT *, row_number() OVER (PARTITION BY kind
          ORDER BY score DESC, name) AS r FROM n) SELECT name, kind, score FROM r WHERE r = 1""",
)
def best_of_kind_query(spark, sf_dir):
    results = tuned_members(spark, sf_dir).select(
        F.col("k").alias("name"),
        F.regexp_extract("k", "^[a-z]+", 0).alias("kind"),
        F.round("macro_f1", 6).alias("score"),
    )
    return en.best_of_kind(results, "score", "kind")


@query(
    "best_candidate",
    f"""WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, {SQL_FOLD_TUNED}
        SELECT k AS name, round(macro_f1, 6) AS score FROM tuned
        ORDER BY (k = 'full2') DESC, round(macro_f1, 6) DESC NULLS LAST, k LIMIT 1""",
)
def best_candidate_query(spark, sf_dir):
    results = tuned_members(spark, sf_dir).select(
        F.col("k").alias("name"), F.round("macro_f1", 6).alias("score")
    )
    return en.best_candidate(results, "full2", "score", order="name")


@query(
    "ensemble_specs",
    f"""WITH {v.SQL_LABELLED}, {SQL_MEMBERS}, seeds_of AS (SELECT DISTINCT fold, CASE fold WHEN 0 THEN 42
        WHEN 1 THEN 13 ELSE 5 + fold END AS seed FROM members),
    {SQL_FOLD_TUNED},
    r AS (SELECT seed, row_number() OVER (ORDER BY round(macro_f1, 6) DESC, seed) AS rank
          FROM tuned JOIN seeds_of ON k = 'full' || fold),
    a AS (SELECT list(seed ORDER BY rank) AS seeds FROM r),
    o AS (SELECT 0 AS spec, 'pair_average' AS name, [42, 13] AS members FROM a
          UNION ALL SELECT 1, 'top2_average', seeds[1:2] FROM a
          UNION ALL SELECT 2, 'top3_average', seeds[1:3] FROM a
          UNION ALL SELECT 3, 'all_average', seeds FROM a)
    SELECT spec, name, members FROM (SELECT *, row_number() OVER
        (PARTITION BY list_sort(members) ORDER BY spec) AS n FROM o) WHERE n = 1""",
)
def specs_query(spark, sf_dir):
    """The folds of one scorer play the seeds 42, 13, 7, 8 and 9."""
    fold = F.regexp_extract("k", "[0-9]+$", 0).cast("int")
    seed = F.when(fold == 0, 42).when(fold == 1, 13).otherwise(fold + 5)
    members = (
        tuned_members(spark, sf_dir)
        .where(F.col("k").startswith("full"))
        .select(seed.alias("seed"), F.round("macro_f1", 6).alias("score"))
    )
    return en.ensemble_specs(members)


@query(
    "best_epoch",
    """WITH h AS (SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, round(avg(value), 4) AS score
       FROM events GROUP BY ALL)
       SELECT run, arg_max(epoch, (score, -epoch)) AS epoch, max(score) AS score FROM h GROUP BY run""",
)
def best_epoch_query(spark, sf_dir):
    """Daily means per event type as a training history."""
    history = (
        v.table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 4).alias("score"))
    )
    return en.best_epoch(history, "score", by=["run"])


@query(
    "kfold_bagged_predict",
    f"""WITH {v.SQL_BOTH}, {SQL_MEMBERS},
    s AS (SELECT id, label, round(avg(score), 7) AS score FROM members GROUP BY id, label),
    {sql_sweep('s', PROB_GRID)},
    best AS (SELECT threshold FROM swept ORDER BY macro_f1 DESC, threshold LIMIT 1),
    bag AS (SELECT id, round((prob + prob_short) / 2, 7) AS prob FROM scores)
    SELECT id, prob, (prob >= (SELECT threshold FROM best))::INT AS label FROM bag""",
)
def bagged_query(spark, sf_dir):
    """Mean of the member probabilities; the threshold comes from the labelled rows."""
    oof = member_scores(spark, sf_dir).groupBy("id", "label").agg(
        F.round(F.avg("score"), 7).alias("score")
    )
    cut = th.tune_threshold_probs(oof).select("threshold").scalar()
    bag = v.unlabelled_scores(spark, sf_dir).select(
        "id", F.round((F.col("prob") + F.col("prob_short")) / 2, 7).alias("prob")
    )
    return bag.withColumn("label", (F.col("prob") >= cut).cast("int"))


SQL_SPLIT = f"""cut AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label
    ORDER BY md5('{v.SEED}:' || id), id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5)
    THEN 'valid' ELSE 'train' END AS split FROM labelled),
held AS (SELECT * FROM cut WHERE split = 'valid'),
m AS (SELECT 'full' AS name, id, label, prob AS score FROM held
      UNION ALL SELECT 'short', id, label, prob_short FROM held
      UNION ALL SELECT 'mean', id, label, round((prob + prob_short) / 2, 7) FROM held)"""


@query(
    "common_split_compare",
    f"""WITH {v.SQL_LABELLED}, {SQL_SPLIT},
    p AS (SELECT name, label, (score >= 0.5)::INT AS pred FROM m), {sql_class_scores('p', 'name')},
    raw AS (SELECT name, avg(f1) AS raw_f1 FROM scores WHERE tp + fp + fn > 0 GROUP BY name),
    {sql_sweep('m', PROB_GRID, 'name')},
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY macro_f1 DESC, threshold) AS r
          FROM swept)
    SELECT name, round(raw_f1, 6) AS raw_f1, round(threshold, 6) AS threshold,
           round(macro_f1, 6) AS tuned_f1 FROM r JOIN raw USING (name) WHERE r = 1""",
)
def common_split_query(spark, sf_dir):
    """Every member and their mean on one fixed validation split."""
    from turnspark.plans.candidates import common_split_scores

    split = stratified_holdout(v.labelled_scores(spark, sf_dir), 0.2, v.SEED)
    each = F.array(
        F.struct(F.lit("full").alias("model"), F.col("prob").alias("score")),
        F.struct(F.lit("short").alias("model"), F.col("prob_short").alias("score")),
    )
    members = split.where("split = 'valid'").select("id", "label", F.explode(each).alias("e"))
    members = members.select("id", "label", "e.*")
    out = common_split_scores(members, {"mean": ["full", "short"]})
    rounded = [F.round(c, 6).alias(c) for c in ("raw_f1", "threshold", "tuned_f1")]
    return out.select("name", *rounded)


@query(
    "gate_accuracy",
    f"""WITH {v.SQL_PAIRS}, {GATED} SELECT round(avg((CASE WHEN r <= 14 THEN diverse_label
        ELSE strong_label END = y)::INT), 6) AS accuracy, count(*) AS n FROM ranked""",
)
def gate_accuracy_query(spark, sf_dir):
    gated = en.confidence_gate(v.gate_pairs(spark, sf_dir), 14)
    out = m.accuracy(gated, (), "y", "label")
    return out.select(F.round("accuracy", 6).alias("accuracy"), "n")
