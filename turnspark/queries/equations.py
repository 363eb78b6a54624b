"""Equations that fitted models have to solve, with the known side computed in SQL.

Solvers have no SQL form, but their solutions do: the normal equations of ridge, the class means that
a discriminant reproduces, the class counts that logistic probabilities add up to and the unit power
of spatial patterns.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from turnspark.models import linear, spatial
from turnspark.operators import trials as tr
from turnspark.queries import views as v
from turnspark.queries.registry import query

FEATURES, ALPHA = 8, 1.0

SQL_FEATURES = f"""d AS (SELECT vec_id AS id, label, embedding FROM embeddings),
f AS (SELECT id, label, CAST(unnest(range(0, {FEATURES})) AS INT) AS j,
      unnest(embedding[1:{FEATURES}])::DOUBLE AS x FROM d)"""


def _rows(spark, sf_dir):
    """id, label and the first numbers of each embedding."""
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        "label",
        F.slice("embedding", 1, FEATURES).cast("array<double>").alias("features"),
    )


def _cells(rows, scored, name="scores"):
    """One row (id, label, j, x, k, s) per feature and score of a row."""
    wide = rows.join(scored.select("id", name), "id")
    each = wide.select("id", "label", F.posexplode("features").alias("j", "x"), name)
    return each.select("id", "label", "j", "x", F.posexplode(name).alias("k", "s"))


@query(
    "ridge_normal_equations",
    f"""WITH {SQL_FEATURES}, c AS (SELECT DISTINCT label AS cls FROM embeddings)
    SELECT c.cls, f.j, round(covar_pop(f.x, CASE WHEN f.label = c.cls THEN 1.0 ELSE -1.0 END), 8) + 0.0 AS v
    FROM f CROSS JOIN c GROUP BY c.cls, f.j""",
)
def ridge_equations_query(spark, sf_dir):
    """cov(x, score) + alpha coef var(x) / n is cov(x, target) for every class and feature."""
    rows = _rows(spark, sf_dir)
    model = linear.fit_ridge(rows, alphas=[ALPHA])
    coef = F.from_json(F.lit(json.dumps(model.coef.tolist())), "array<array<double>>")
    classes = F.lit(json.dumps(model.classes))
    sums = _cells(rows, model.decide(rows)).groupBy("k", "j").agg(
        F.covar_pop("x", "s").alias("c"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n")
    )
    penalty = ALPHA * F.get(F.get(coef, F.col("k")), F.col("j")) * F.col("var") / F.col("n")
    return sums.select(
        F.get(F.from_json(classes, "array<int>"), F.col("k")).alias("cls"),
        "j",
        (F.round(F.col("c") + penalty, 8) + 0.0).alias("v"),
    )


@query(
    "lda_class_means",
    f"""WITH {SQL_FEATURES} SELECT label AS cls, j, round(avg(x), 7) + 0.0 AS v
    FROM f GROUP BY label, j""",
)
def lda_equations_query(spark, sf_dir):
    """Without shrinkage, score k and feature j covary within the classes by the mean of j in class k."""
    rows = _rows(spark, sf_dir)
    model = linear.fit_lda(rows, shrink=False)
    within = _cells(rows, model.decide(rows)).groupBy("label", "k", "j").agg(
        F.covar_pop("x", "s").alias("c"), F.count(F.lit(1)).alias("n")
    )
    pooled = within.groupBy("k", "j").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("c"))
    classes = F.from_json(F.lit(json.dumps(model.classes)), "array<int>")
    return pooled.select(F.get(classes, F.col("k")).alias("cls"), "j", (F.round("c", 7) + 0.0).alias("v"))


@query(
    "logistic_class_counts",
    """SELECT label AS cls, count(*) AS n, TRUE AS adds_up, TRUE AS settled FROM embeddings GROUP BY label""",
)
def logistic_equations_query(spark, sf_dir):
    """Probabilities add up to the class counts, and x (p - y) / n + coef / (C n) vanishes."""
    c = 0.1
    rows = _rows(spark, sf_dir)
    model = linear.fit_multinomial(rows, c=c)
    coef = F.from_json(
        F.lit(json.dumps(model.coefficientMatrix.toArray().tolist())), "array<array<double>>"
    )
    cells = _cells(rows, linear.logistic_probs(rows, model), "probs")
    hit = (F.col("label") == F.col("k")).cast("double")
    sums = cells.groupBy("k", "j").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(hit).cast("bigint").alias("n"),
        F.avg(F.col("s") - hit).alias("bias"),
        F.avg(F.col("x") * (F.col("s") - hit)).alias("slope"),
    )
    pull = F.get(F.get(coef, F.col("k")), F.col("j")) / (c * F.col("rows"))
    return sums.groupBy(F.col("k").alias("cls")).agg(
        F.max("n").alias("n"),
        F.every(F.abs("bias") < 1e-4).alias("adds_up"),
        F.every(F.abs(F.col("slope") + pull) < 1e-4).alias("settled"),
    )


@query(
    "csp_unit_power",
    """SELECT CAST(unnest(range(0, 4)) AS INT) AS k, 1.0::DOUBLE AS power,
       (SELECT count(*) * 5 FROM embeddings) AS n""",
)
def csp_equations_query(spark, sf_dir):
    """The patterns' mean power over all windows is one."""
    covs = tr.window_covariances(v.trials(spark, sf_dir), 8, 2)
    rows = spatial.csp_filters(*spatial.mean_class_covariances(covs, "y"), 4)
    cells = spatial.csp_features(covs, rows).select(F.posexplode("features").alias("k", "x"))
    return cells.groupBy("k").agg(
        F.round(F.avg(F.exp("x")), 8).alias("power"), F.count(F.lit(1)).alias("n")
    )
