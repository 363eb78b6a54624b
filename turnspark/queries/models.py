"""Estimators fitted on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnspark.functions.scores import argmax_label
from turnspark.lineage import ensure_checkpoint_dir
from turnspark.models import linear, riemann, spatial
from turnspark.models import trial_models as tm
from turnspark.operators import metrics as m
from turnspark.operators import trials as tr
from turnspark.operators.splits import hold_group
from turnspark.plans import alignment as al
from turnspark.plans import inference as inf
from turnspark.queries import views as v
from turnspark.queries.registry import query
from turnspark.sources.labels import read_label_files

SIZE, STRIDE = 8, 2


def _split(spark, sf_dir):
    """Subject 9 is held out."""
    marked = hold_group(v.trials(spark, sf_dir), "subject", 9)
    train = marked.where("split = 'train'").drop("split")
    return train, marked.where("split = 'valid'").drop("split")


def _rounded_probs(df):
    return df.withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))


@query("tangent_space")
def tangent_query(spark, sf_dir):
    covs = al.aligned_windows(v.trials(spark, sf_dir), SIZE, STRIDE)
    features = riemann.tangent_features(covs, riemann.karcher_mean(covs))
    return features.select(
        "subject", "trial", "w", F.transform("features", lambda x: F.round(x, 5)).alias("features")
    )


@query(
    "tangent_space_mean",
    """SELECT CAST(unnest(range(0, 10)) AS INT) AS k, 0.0::DOUBLE AS v,
       (SELECT count(*) * 5 FROM embeddings) AS n""",
)
def tangent_mean_query(spark, sf_dir):
    """At the Karcher mean the tangent vectors of all windows add up to zero."""
    covs = al.aligned_windows(v.trials(spark, sf_dir), SIZE, STRIDE)
    features = riemann.tangent_features(covs, riemann.karcher_mean(covs))
    cells = features.select(F.posexplode("features").alias("k", "x"))
    return cells.groupBy("k").agg(
        (F.round(F.avg("x"), 6) + F.lit(0.0)).alias("v"), F.count(F.lit(1)).alias("n")
    )


@query("mdm")
def mdm_query(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    covs = al.aligned_windows(train, SIZE, STRIDE)
    means = riemann.karcher_means(covs, "y", range(4))
    held = al.aligned_windows(valid, SIZE, STRIDE)
    return _rounded_probs(al.vote(riemann.mdm_probs(held, means, range(4)), 4))


@query("mdm_leave_one_subject_out")
def mdm_loso_query(spark, sf_dir):
    voted = al.leave_one_subject_out_mdm(
        v.trials(spark, sf_dir), SIZE, STRIDE, range(4), range(10)
    )
    return m.loso_report(voted, "subject", "y", "pred")


@query("csp_lda")
def csp_lda_query(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    return _rounded_probs(al.vote(al.csp_lda_probs(train, valid, SIZE, STRIDE), 4))


@query("csp_ridge")
def csp_ridge_query(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    return _rounded_probs(al.csp_ridge_votes(train, valid, SIZE, STRIDE))


@query("xdawn_tangent")
def xdawn_query(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    return _rounded_probs(al.vote(al.xdawn_probs(train, valid, SIZE, STRIDE), 4))


@query("align_and_classify")
def align_query(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    return _rounded_probs(al.align_and_classify(train, valid, SIZE, STRIDE, 4))


def _wide(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


@query("lda_shrinkage")
def lda_query(spark, sf_dir):
    rows = _wide(spark, sf_dir)
    return linear.fit_lda(rows).decide(rows).select(
        "id", "label", argmax_label(F.col("scores")).alias("pred")
    )


@query("ridge_classifier_cv")
def ridge_query(spark, sf_dir):
    rows = _wide(spark, sf_dir)
    model = linear.fit_ridge(rows)
    return model.decide(rows).select(
        "id",
        "label",
        argmax_label(F.col("scores")).alias("pred"),
        F.lit(float(model.info["alpha"])).alias("alpha"),
    )


@query("logistic_multinomial")
def logistic_query(spark, sf_dir):
    rows = _wide(spark, sf_dir)
    model = linear.fit_multinomial(rows, c=0.1)
    return _rounded_probs(linear.logistic_probs(rows, model)).withColumn(
        "pred", argmax_label(F.col("probs"))
    )


# The compared frequency bands in Hz.
BANDS = {"alpha": (8, 13), "beta": (13, 30), "broad": (4, 40), "high_gamma": (70, 125)}


@query("band_sweep")
def band_sweep_query(spark, sf_dir):
    """Two channels of 32 samples; minimum distance to mean within each band."""

    def fit_and_score(trials):
        return al.leave_one_subject_out_mdm(trials, 16, 8, range(4), range(10))

    return al.band_sweep(v.trials(spark, sf_dir, channels=2), BANDS, 250.0, fit_and_score)


@query("xdawn_covariances")
def xdawn_cov_query(spark, sf_dir):
    windows = tr.sliding_windows(v.trials(spark, sf_dir), SIZE, STRIDE)
    covs = spatial.xdawn_covariances(windows, spatial.fit_xdawn(windows, "y", 4))
    return covs.select("trial", "w", F.transform("cov", lambda x: F.round(x, 6)).alias("cov"))


@query("csp_features")
def csp_query(spark, sf_dir):
    covs = tr.window_covariances(v.trials(spark, sf_dir), SIZE, STRIDE)
    rows = spatial.csp_filters(*spatial.mean_class_covariances(covs, "y"), 4)
    return spatial.csp_features(covs, rows).select(
        "trial", "w", F.transform("features", lambda x: F.round(x, 6)).alias("features")
    )


GATE_K = 14
FOUR = (0, 1, 2, 3)


@query(
    "gated_inference",
    f"""WITH t AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 9)
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id AS trial, TRUE AS in_domain,
      TRUE AS as_gated, TRUE AS gate_holds_lowest, least({GATE_K}, count(*) OVER ()) AS n_gated FROM t""",
)
def gated_query(spark, sf_dir):
    """Fit strong and diverse models, save, reload, gate, validate, write; then check the file.

    Fitted labels have no SQL form, so the row states what must hold of each: a class of the domain,
    the label of the model that the gate picked, and no ungated trial below a gated one.
    """
    train, valid = _split(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark)}/gated-{uuid.uuid4().hex}"
    strong = [tm.TrialRecipe(kind, SIZE, STRIDE, FOUR) for kind in ("tangent", "mdm")]
    diverse = [tm.TrialRecipe("csp_lda", SIZE, STRIDE, FOUR)]
    tm.save_bundle(spark, inf.fit_bundle(train, strong, diverse, GATE_K), f"{base}/bundle")
    bundle = tm.load_bundle(spark, f"{base}/bundle")
    gated = inf.gated_inference(bundle, valid)
    inf.write_predictions(gated, valid, FOUR, f"{base}/labels")
    written = read_label_files(spark, f"{base}/labels").where("not is_first").select(
        "pos",
        F.expr("try_cast(id AS BIGINT)").alias("trial"),
        F.expr("try_cast(label AS INT)").alias("written"),
    )
    border = gated.agg(
        F.count_if("gated").alias("n_gated"),
        F.max(F.when(F.col("gated"), F.col("confidence"))).alias("highest_gated"),
    )
    both = gated.join(written, "trial").join(F.broadcast(border))
    picked = F.when(F.col("gated"), F.col("diverse_label")).otherwise(F.col("strong_label"))
    return both.select(
        "pos",
        "trial",
        F.col("written").isin(*FOUR).alias("in_domain"),
        (F.col("written") == picked).alias("as_gated"),
        (F.col("gated") | (F.col("confidence") >= F.col("highest_gated"))).alias("gate_holds_lowest"),
        "n_gated",
    )


@query(
    "leave_subjects_out",
    """SELECT kind, CAST(vec_id % 10 AS INT) AS subject, count(*) AS n, TRUE AS scored
    FROM embeddings, (VALUES ('csp_lda'), ('tangent'), ('xdawn')) AS k(kind) GROUP BY ALL""",
)
def leave_out_query(spark, sf_dir):
    """Three classifiers, each trial scored by a model of the other subjects."""
    out = None
    for kind in ("csp_lda", "tangent", "xdawn"):
        recipe = tm.TrialRecipe(kind, SIZE, STRIDE, FOUR)
        voted = inf.leave_groups_out(v.trials(spark, sf_dir), recipe, range(10))
        total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
        part = voted.groupBy("subject").agg(
            F.count(F.lit(1)).alias("n"),
            F.every((F.abs(total - 1) < 1e-9) & F.col("pred").isin(*FOUR)).alias("scored"),
        )
        part = part.select(F.lit(kind).alias("kind"), "subject", "n", "scored")
        out = part if out is None else out.unionByName(part)
    return out
