"""Folds, hold-outs and class balance over the labelled turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspark.operators import balance, splits
from turnspark.queries import views as v
from turnspark.queries.registry import query

S = v.SEED
HASH = f"md5('{S}:' || id)"
LABELS = "t AS (SELECT doc_id AS id, quality AS label FROM labels)"


def labels(spark, sf_dir):
    return v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )


@query(
    "stratified_kfold",
    f"""WITH {LABELS} SELECT id, label, CAST((row_number() OVER (PARTITION BY label
        ORDER BY {HASH}, id) - 1) % {v.FOLDS} AS INT) AS fold FROM t""",
)
def kfold_query(spark, sf_dir):
    return splits.stratified_kfold(labels(spark, sf_dir), v.FOLDS, S)


@query(
    "stratified_holdout",
    f"""WITH {LABELS} SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label
        ORDER BY {HASH}, id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5)
        THEN 'valid' ELSE 'train' END AS split FROM t""",
)
def holdout_query(spark, sf_dir):
    return splits.stratified_holdout(labels(spark, sf_dir), 0.2, S)


@query(
    "random_holdout",
    f"""WITH t AS (SELECT vec_id AS id FROM embeddings)
        SELECT id, CASE WHEN row_number() OVER (ORDER BY {HASH}, id) <= greatest(1,
        least(floor(count(*) OVER () * 0.75::DOUBLE + 0.5), count(*) OVER () - 1))
        THEN 'train' ELSE 'valid' END AS split FROM t""",
)
def random_holdout_query(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return splits.random_holdout(rows, 0.25, S)


TRIAL_KEYS = """t AS (SELECT vec_id AS trial, CAST(vec_id % 10 AS INT) AS subject,
                CAST(label % 4 AS INT) AS y FROM embeddings)"""


def trial_keys(spark, sf_dir):
    return v.trials(spark, sf_dir).drop("x")


@query("leave_one_group_out", f"WITH {TRIAL_KEYS} SELECT *, subject AS fold FROM t")
def logo_query(spark, sf_dir):
    return splits.leave_one_group_out(trial_keys(spark, sf_dir), "subject")


@query(
    "hold_group",
    f"""WITH {TRIAL_KEYS} SELECT *, CASE WHEN subject = 9 THEN 'valid' ELSE 'train' END AS split
        FROM t""",
)
def hold_group_query(spark, sf_dir):
    return splits.hold_group(trial_keys(spark, sf_dir), "subject", 9)


@query(
    "stratified_subset",
    f"""WITH {LABELS},
    n AS (SELECT label, count(*) AS m, 160 * count(*)::DOUBLE / sum(count(*)) OVER () AS x,
          sum(count(*)) OVER () AS total FROM t GROUP BY label),
    q AS (SELECT label, total, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, label)
          <= 160 - sum(floor(x)) OVER ())::INT AS quota FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, id) AS rank FROM t)
    SELECT id, r.label FROM r JOIN q USING (label) WHERE total <= 160 OR rank <= quota""",
)
def subset_query(spark, sf_dir):
    return splits.stratified_subset(labels(spark, sf_dir), 160, S)


@query(
    "balanced_weights",
    f"""WITH {LABELS} SELECT id, label, round(count(*) OVER () / ((SELECT count(DISTINCT label)
        FROM t) * count(*) OVER (PARTITION BY label))::DOUBLE, 6) AS weight FROM t""",
)
def weights_query(spark, sf_dir):
    weighted = balance.balanced_weights(labels(spark, sf_dir))
    return weighted.select("id", "label", F.round("weight", 6).alias("weight"))


def sql_oversample(id_type: str) -> str:
    return f"""
sizes AS (SELECT label, count(*) AS n FROM t GROUP BY label),
big AS (SELECT label FROM sizes ORDER BY n DESC, label LIMIT 1),
major AS (SELECT t.* FROM t JOIN big USING (label)),
minor AS (SELECT t.*, row_number() OVER (ORDER BY {HASH}, id) AS rank FROM t
          WHERE label NOT IN (SELECT label FROM big)),
draws AS (SELECT id AS draw_id, 1 + ('0x' || substr(md5('{S}:draw:' || id), 1, 15))::BIGINT
          % (SELECT count(*) FROM minor) AS rank FROM major),
balanced AS (SELECT id, label, NULL::{id_type} AS draw_id FROM major UNION ALL
             SELECT m.id, m.label, d.draw_id FROM draws d JOIN minor m USING (rank))
SELECT *, md5('{S}:shuffle:' || id || ':' || coalesce(draw_id::VARCHAR, '-1')) AS shuffle_key FROM balanced"""


@query("random_oversample", f"WITH {LABELS}, {sql_oversample('BIGINT')}")
def oversample_query(spark, sf_dir):
    return balance.random_oversample(labels(spark, sf_dir), S)


@query(
    "random_oversample_text_ids",
    f"""WITH t AS (SELECT 'turn-' || doc_id AS id, quality AS label FROM labels), {sql_oversample('VARCHAR')}""",
)
def oversample_text_query(spark, sf_dir):
    """Ids that are not numbers."""
    named = labels(spark, sf_dir).withColumn("id", F.concat(F.lit("turn-"), F.col("id").cast("string")))
    return balance.random_oversample(named, S)


@query(
    "oversample_per_fold",
    f"""WITH {LABELS},
    folds AS (SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {HASH}, id) - 1)
              % {v.FOLDS} AS INT) AS fold FROM t),
    held AS (SELECT DISTINCT fold AS f FROM folds),
    train AS (SELECT f, id, label FROM folds JOIN held ON fold <> f),
    sizes AS (SELECT f, label, count(*) AS n FROM train GROUP BY f, label),
    top AS (SELECT f, arg_max(label, (n, -label)) AS big, max(n) AS n_big FROM sizes GROUP BY f)
    SELECT train.f AS fold, label, CASE WHEN label = big THEN count(*) ELSE n_big END AS n
    FROM train JOIN top ON train.f = top.f GROUP BY train.f, label, big, n_big""",
)
def oversample_folds_query(spark, sf_dir):
    """Balanced training rows of every fold; the draw differs from fold to fold."""
    folds = splits.stratified_kfold(labels(spark, sf_dir), v.FOLDS, S)
    out = None
    for fold in range(v.FOLDS):
        train = folds.where(F.col("fold") != fold).drop("fold")
        part = balance.random_oversample(train, S + fold + 1).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


def mixed(spark, sf_dir):
    flat = v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 4).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    return flat, balance.mixup(flat, 32, 0.2, S)


@query("mixup")
def mixup_query(spark, sf_dir):
    return mixed(spark, sf_dir)[1]


@query(
    "mixup_pairs",
    f"""WITH r AS (SELECT vec_id AS id, label % 4 AS y,
          row_number() OVER (ORDER BY md5('{S}:' || vec_id), vec_id) - 1 AS place FROM embeddings),
    slots AS (SELECT id, y, place // 32 AS batch, place % 32 AS slot,
          least(32, (SELECT count(*) FROM r) - 32 * (place // 32)) AS held FROM r),
    wanted AS (SELECT *, (slot + ('0x' || substr(md5('{S}:shift:' || batch), 1, 15))::BIGINT % held)
          % held AS want FROM slots)
    SELECT w.id, p.id AS partner_id, w.batch, w.y AS y_a, p.y AS y_b, 1 AS shares_in_batch,
      true AS blended FROM wanted w JOIN slots p ON w.batch = p.batch AND w.want = p.slot""",
)
def mixup_pairs_query(spark, sf_dir):
    """Partners, and whether every row is its batch's share of itself and the rest of its partner."""
    flat, out = mixed(spark, sf_dir)
    shares = out.groupBy("batch").agg(F.count_distinct("lam").alias("shares_in_batch"))
    own = flat.select("id", F.col("x").alias("a"))
    other = flat.select(F.col("id").alias("partner_id"), F.col("x").alias("b"))
    rows = out.join(own, "id").join(other, "partner_id").join(shares, "batch")
    parts = F.zip_with("a", "b", lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b)
    near = F.zip_with("x", parts, lambda got, want: F.abs(got - want) < 1e-12)
    return rows.select(
        "id", "partner_id", "batch", "y_a", "y_b", "shares_in_batch",
        (F.forall(near, lambda ok: ok) & F.col("lam").between(0, 1)).alias("blended"),
    )
