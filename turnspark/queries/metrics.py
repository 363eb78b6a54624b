"""Metrics and thresholds over the fixed scorer's probabilities."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from turnspark.functions.scores import (
    argmax_label,
    binary_score,
    confidence,
    labels_from_scores,
    logit,
    margin,
    softmax,
)
from turnspark.lineage import cut_lineage
from turnspark.operators import metrics as m
from turnspark.operators import thresholds as th
from turnspark.operators.splits import stratified_kfold
from turnspark.queries import views as v
from turnspark.queries.registry import query

L = v.SQL_LABELLED
PRED = "p AS (SELECT id, label, prob, (prob >= 0.5)::INT AS pred FROM labelled)"


def predictions(spark, sf_dir):
    scores = v.labelled_scores(spark, sf_dir)
    return scores.withColumn("pred", labels_from_scores(F.col("prob"), 0.5))


def with_folds(df):
    return stratified_kfold(df, v.FOLDS, v.SEED)


SQL_FOLDED = f"""folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5('{v.SEED}:' || id), id) - 1) % {v.FOLDS} AS INT) AS fold FROM labelled)"""


@query(
    "labels_from_scores",
    f"""WITH {L} SELECT id, prob, (prob >= 0.6::DOUBLE)::INT AS at_least,
        (ln(prob / (1 - prob)) > 0)::INT AS above_zero FROM labelled""",
)
def labels_query(spark, sf_dir):
    return v.labelled_scores(spark, sf_dir).select(
        "id",
        "prob",
        labels_from_scores(F.col("prob"), 0.6).alias("at_least"),
        labels_from_scores(logit(F.col("prob")), 0.0, strict=True).alias("above_zero"),
    )


@query(
    "binary_score",
    f"""WITH {L} SELECT id, round(ln(prob / (1 - prob)), 6) AS decision, prob AS class1 FROM labelled""",
)
def binary_query(spark, sf_dir):
    """The one number per row behind two-class raw predictions and probabilities."""
    odds = logit(F.col("prob"))
    outputs = v.labelled_scores(spark, sf_dir).select(
        "id",
        array_to_vector(F.array(-odds, odds)).alias("raw"),
        array_to_vector(F.array(1 - F.col("prob"), "prob")).alias("probability"),
    )
    return outputs.select(
        "id",
        F.round(binary_score(F.col("raw")), 6).alias("decision"),
        binary_score(F.col("probability")).alias("class1"),
    )


@query(
    "margin",
    f"WITH {L} SELECT id, round(abs(prob - 0.46::DOUBLE), 6) AS margin FROM labelled",
)
def margin_query(spark, sf_dir):
    return v.labelled_scores(spark, sf_dir).select(
        "id", F.round(margin(F.col("prob"), 0.46), 6).alias("margin")
    )


@query(
    "softmax",
    """WITH c AS (SELECT vec_id AS id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS z
       FROM embeddings), e AS (SELECT id, i, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM c),
       s AS (SELECT id, i, e / sum(e) OVER (PARTITION BY id) AS p FROM e)
       SELECT id, round(max(p), 6) AS top, round(min(p), 6) AS low, round(sum(p * i), 5) AS centre
       FROM s GROUP BY id""",
)
def softmax_query(spark, sf_dir):
    probs = softmax(F.col("embedding").cast("array<double>"))
    weighted = F.transform(F.col("p"), lambda x, i: x * i)
    return (
        v.table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("id"), probs.alias("p"))
        .select(
            "id",
            F.round(F.array_max("p"), 6).alias("top"),
            F.round(F.array_min("p"), 6).alias("low"),
            F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 5).alias("centre"),
        )
    )


@query(
    "argmax_confidence",
    f"""WITH {v.SQL_STRONG} SELECT id, CAST(arg_max(cls, (p, -cls)) AS INT) AS label,
        max(p) AS confidence FROM strong GROUP BY id""",
)
def argmax_query(spark, sf_dir):
    return v.strong_probs(spark, sf_dir).select(
        "id",
        argmax_label(F.col("probs")).alias("label"),
        confidence(F.col("probs")).alias("confidence"),
    )


@query(
    "label_distribution",
    """WITH d AS (SELECT unnest([0, 1, 2]) AS label),
       c AS (SELECT d.label, count(l.quality) AS n FROM d LEFT JOIN labels l ON l.quality = d.label
             GROUP BY d.label)
       SELECT label, n, CASE WHEN min(n) OVER () > 0
              THEN max(n) OVER () / (min(n) OVER ())::DOUBLE END AS imbalance FROM c""",
)
def distribution_query(spark, sf_dir):
    return m.label_distribution(v.table(spark, sf_dir, "labels"), (0, 1, 2), "quality")


@query(
    "id_uniqueness",
    "SELECT count(*) AS n_rows, count(DISTINCT md5(text)) AS n_ids FROM documents",
)
def uniqueness_query(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.md5("text").alias("id"))
    return m.id_uniqueness(docs)


@query(
    "confusion_matrix",
    f"""WITH {L}, {PRED}, d AS (SELECT unnest([0, 1]) AS c)
        SELECT a.c AS label, b.c AS pred, count(p.id) AS n FROM d a CROSS JOIN d b
        LEFT JOIN p ON p.label = a.c AND p.pred = b.c GROUP BY a.c, b.c""",
)
def confusion_query(spark, sf_dir):
    return m.confusion_matrix(predictions(spark, sf_dir), (0, 1))


def sql_class_scores(source: str, by: str = "") -> str:
    base = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    match = f"q.{by} = s.{by}" if by else "TRUE"
    pick = f"q.{by}, " if by else ""
    return f"""cells AS (SELECT {pick}d.c AS label,
        count(*) FILTER (s.label = d.c AND s.pred = d.c) AS tp,
        count(*) FILTER (s.label <> d.c AND s.pred = d.c) AS fp,
        count(*) FILTER (s.label = d.c AND s.pred <> d.c) AS fn
        FROM {base} q CROSS JOIN (SELECT unnest([0, 1]) AS c) d JOIN {source} s ON {match}
        GROUP BY {pick}d.c),
    scores AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
        tp + fn AS support FROM cells)"""


@query(
    "classification_report",
    f"""WITH {L}, {PRED}, {sql_class_scores('p')},
    rows AS (SELECT label::VARCHAR AS name, precision, recall, f1, support FROM scores UNION ALL
      SELECT 'accuracy', a, a, a, s FROM (SELECT sum(tp) / sum(support)::DOUBLE AS a,
             sum(support) AS s FROM scores) UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores UNION ALL
      SELECT 'weighted avg', sum(precision * support) / sum(support),
             sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
      FROM scores)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           support::BIGINT AS support FROM rows""",
)
def report_query(spark, sf_dir):
    report = m.classification_report(predictions(spark, sf_dir), (0, 1))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("name", *rounded, "support")


@query(
    "macro_f1",
    f"""WITH {L}, {PRED}, {sql_class_scores('p')}
        SELECT round(avg(f1), 6) AS macro_f1 FROM scores WHERE tp + fp + fn > 0""",
)
def macro_query(spark, sf_dir):
    scored = m.macro_f1(predictions(spark, sf_dir), (0, 1))
    return scored.select(F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "summarize_oof",
    f"""WITH {L}, o AS (SELECT *, (prob >= 0.46::DOUBLE)::INT AS pred FROM labelled),
    c AS (SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn,
          count(*) FILTER (label = 0 AND pred = 1) AS fp,
          count(*) FILTER (label = 1 AND pred = 0) AS fn,
          count(*) FILTER (label = 1 AND pred = 1) AS tp FROM o),
    f AS (SELECT *, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE, 0) AS f0,
          coalesce(2 * tp / nullif(2 * tp + fn + fp, 0)::DOUBLE, 0) AS f1 FROM c)
    SELECT tn, fp, fn, tp, round(f0, 6) AS class0_f1, round(f1, 6) AS class1_f1,
           round((f0 + f1) / 2, 6) AS macro_f1, tn + fn AS predicted0, tp + fp AS predicted1 FROM f""",
)
def summarize_query(spark, sf_dir):
    scores = v.labelled_scores(spark, sf_dir)
    pred = scores.withColumn("pred", labels_from_scores(F.col("prob"), 0.46))
    out = m.summarize_oof(pred)
    rounded = [F.round(c, 6).alias(c) for c in ("class0_f1", "class1_f1", "macro_f1")]
    return out.select("tn", "fp", "fn", "tp", *rounded, "predicted0", "predicted1")


@query(
    "fold_summary",
    f"""WITH {L}, {SQL_FOLDED}, p AS (SELECT *, (prob >= 0.46::DOUBLE)::INT AS pred FROM folded),
    {sql_class_scores('p', 'fold')},
    f AS (SELECT fold, avg(f1) AS s FROM scores WHERE tp + fp + fn > 0 GROUP BY fold)
    SELECT round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS std_score,
           list(round(s, 4) ORDER BY fold) AS fold_scores FROM f""",
)
def fold_summary_query(spark, sf_dir):
    scores = with_folds(v.labelled_scores(spark, sf_dir))
    pred = scores.withColumn("pred", labels_from_scores(F.col("prob"), 0.46))
    folds = m.macro_f1(pred, (0, 1), ["fold"])
    out = m.fold_summary(folds, "macro_f1")
    return out.select(
        F.round("mean_score", 6).alias("mean_score"),
        F.round("std_score", 6).alias("std_score"),
        "fold_scores",
    )


@query(
    "confidence_summary",
    f"""WITH {v.SQL_UNLABELLED}, c AS (SELECT prob FROM scores
        WHERE (prob >= 0.46::DOUBLE) <> (prob_short >= 0.5::DOUBLE))
    SELECT count(*) AS count, round(min(abs(prob - 0.46::DOUBLE)), 6) AS min_margin,
           round(avg(abs(prob - 0.46::DOUBLE)), 6) AS mean_margin, min(prob) AS min_prob,
           max(prob) AS max_prob FROM c""",
)
def confidence_query(spark, sf_dir):
    scores = v.unlabelled_scores(spark, sf_dir)
    changed = scores.where((F.col("prob") >= 0.46) != (F.col("prob_short") >= 0.5))
    out = m.confidence_summary(changed, 0.46)
    return out.select(
        "count",
        F.round("min_margin", 6).alias("min_margin"),
        F.round("mean_margin", 6).alias("mean_margin"),
        "min_prob",
        "max_prob",
    )


@query(
    "pseudo_label_counts",
    f"""WITH {v.SQL_UNLABELLED},
    cuts AS (SELECT unnest([0.99, 0.98, 0.95])::DOUBLE AS cut, unnest([0.01, 0.02, 0.05])::DOUBLE AS low),
    z AS (SELECT round(1 / (1 + exp(-6 * ln(prob / (1 - prob)))), 6) AS p FROM scores)
    SELECT cut, count(*) FILTER (p >= cut) AS positive, count(*) FILTER (p <= low) AS negative
    FROM z CROSS JOIN cuts GROUP BY cut""",
)
def pseudo_query(spark, sf_dir):
    sharpened = F.round(1 / (1 + F.exp(-6 * logit(F.col("prob")))), 6)
    scores = v.unlabelled_scores(spark, sf_dir).select(sharpened.alias("prob"))
    return m.pseudo_label_counts(scores)


@query(
    "accuracy_and_logloss",
    f"""WITH {v.SQL_STRONG}, best AS (SELECT id, y, arg_max(cls, (p, -cls)) AS label,
        max(p) FILTER (cls = y) AS own FROM strong GROUP BY id, y)
    SELECT round(avg((label = y)::INT), 6) AS accuracy,
           round(avg(-ln(greatest(own, 1e-12))), 6) AS log_loss, count(*) AS n FROM best""",
)
def logloss_query(spark, sf_dir):
    out = m.accuracy_and_logloss(v.strong_probs(spark, sf_dir), label="y")
    return out.select(
        F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"), "n"
    )


@query(
    "loso_report",
    f"""WITH {v.SQL_STRONG}, b AS (SELECT id % 10 AS subject, y,
        arg_max(cls, (p, -cls)) AS label FROM strong GROUP BY id, y),
    g AS (SELECT subject, avg((label = y)::INT) AS a, count(*) AS n FROM b GROUP BY subject)
    SELECT subject, round(a, 6) AS accuracy, n, round(avg(a) OVER (), 6) AS mean_accuracy,
           round(stddev_pop(a) OVER (), 6) AS std_accuracy FROM g""",
)
def loso_query(spark, sf_dir):
    rows = v.strong_probs(spark, sf_dir).select(
        (F.col("id") % 10).alias("subject"), "y", argmax_label(F.col("probs")).alias("pred")
    )
    out = m.loso_report(rows, "subject", "y")
    rounded = [F.round(c, 6).alias(c) for c in ("accuracy", "mean_accuracy", "std_accuracy")]
    return out.select("subject", "n", *rounded)


def sql_sweep(source: str, grid: str, by: str = "") -> str:
    key = f"s.{by}, " if by else ""
    return f"""{grid},
    counts AS (SELECT {key}g.threshold,
        count(*) FILTER (s.label = 1 AND s.score >= g.threshold) AS tp,
        count(*) FILTER (s.label = 0 AND s.score >= g.threshold) AS fp,
        count(*) FILTER (s.label = 1 AND s.score < g.threshold) AS fn,
        count(*) FILTER (s.label = 0 AND s.score < g.threshold) AS tn
        FROM {source} s CROSS JOIN grid g GROUP BY {key}g.threshold),
    f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
          coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) AS f0,
          (tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT AS seen FROM counts),
    swept AS (SELECT *, (f0 + f1) / seen AS macro_f1 FROM f)"""


PROB_GRID = """grid AS (SELECT 0.3::DOUBLE + i * 0.01::DOUBLE AS threshold
    FROM (SELECT unnest(range(0, 41)) AS i))"""
SCORED = "s AS (SELECT id, label, prob AS score FROM labelled)"


@query(
    "threshold_sweep",
    f"""WITH {L}, {SCORED}, {sql_sweep('s', PROB_GRID)} SELECT round(threshold, 6) AS threshold,
        tp, fp, fn, tn, round(macro_f1, 6) AS macro_f1 FROM swept""",
)
def sweep_query(spark, sf_dir):
    scores = v.labelled_scores(spark, sf_dir)
    out = th.sweep(scores, th.prob_grid(), "prob")
    return out.select(
        F.round("threshold", 6).alias("threshold"),
        "tp", "fp", "fn", "tn",
        F.round("macro_f1", 6).alias("macro_f1"),
    )


BEST = """SELECT round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1, tp, fp, fn, tn
    FROM swept ORDER BY swept.macro_f1 DESC, swept.threshold LIMIT 1"""


def rounded_best(best, *keys):
    return best.select(
        *keys,
        F.round("threshold", 6).alias("threshold"),
        F.round("macro_f1", 6).alias("macro_f1"),
        "tp", "fp", "fn", "tn",
    )


@query(
    "tune_threshold_probs",
    f"WITH {L}, {SCORED}, {sql_sweep('s', PROB_GRID)} {BEST}",
)
def tune_probs_query(spark, sf_dir):
    return rounded_best(th.tune_threshold_probs(v.labelled_scores(spark, sf_dir), "prob"))


@query(
    "tune_threshold_per_fold",
    f"""WITH {L}, {SQL_FOLDED}, s AS (SELECT fold, id, label, prob AS score FROM folded),
    {sql_sweep('s', PROB_GRID, 'fold')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY macro_f1 DESC, threshold) AS r
               FROM swept)
    SELECT fold, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1, tp, fp, fn, tn
    FROM ranked WHERE r = 1""",
)
def tune_fold_query(spark, sf_dir):
    scores = with_folds(v.labelled_scores(spark, sf_dir))
    return rounded_best(th.tune_threshold_probs(scores, "prob", by=["fold"]), "fold")


SIGNED = "s AS (SELECT id, label, round(ln(prob / (1 - prob)), 6) AS score FROM labelled)"
SCORE_GRID = """o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r,
        count(*) OVER () - 1 AS n FROM s),
    q AS (SELECT max(score) FILTER (r = floor(n * 0.01::DOUBLE)) AS a0,
                 max(score) FILTER (r = ceil(n * 0.01::DOUBLE)) AS a1,
                 max(n) * 0.01::DOUBLE - floor(max(n) * 0.01::DOUBLE) AS fa,
                 max(score) FILTER (r = floor(n * 0.99::DOUBLE)) AS b0,
                 max(score) FILTER (r = ceil(n * 0.99::DOUBLE)) AS b1,
                 max(n) * 0.99::DOUBLE - floor(max(n) * 0.99::DOUBLE) AS fb FROM o),
    e AS (SELECT a0 + (a1 - a0) * fa AS low, b0 + (b1 - b0) * fb AS high FROM q),
    grid AS (SELECT low + i * ((high - low) / 400::DOUBLE) AS threshold
             FROM e CROSS JOIN (SELECT unnest(range(0, 401)) AS i) UNION SELECT 0.0::DOUBLE)"""


def signed_scores(spark, sf_dir):
    odds = F.round(logit(F.col("prob")), 6)
    return v.labelled_scores(spark, sf_dir).select("id", "label", odds.alias("score"))


@query(
    "threshold_grid",
    f"WITH {L}, {SIGNED}, {SCORE_GRID} SELECT round(threshold, 6) AS threshold FROM grid",
)
def grid_query(spark, sf_dir):
    grid = th.threshold_grid(cut_lineage(signed_scores(spark, sf_dir)), "score")
    return grid.table(spark).select(F.round("threshold", 6).alias("threshold"))


@query(
    "tune_threshold_scores",
    f"WITH {L}, {SIGNED}, {sql_sweep('s', SCORE_GRID)} {BEST}",
)
def tune_scores_query(spark, sf_dir):
    return rounded_best(th.tune_threshold_scores(signed_scores(spark, sf_dir)))
