"""Sources and sinks over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnspark.lineage import ensure_checkpoint_dir
from turnspark.operators.splits import stratified_holdout
from turnspark.queries import views as v
from turnspark.queries.metrics import PROB_GRID, sql_class_scores, sql_sweep
from turnspark.queries.registry import query
from turnspark.ranking import position_rows
from turnspark.sources import labels as lb
from turnspark.sources import scores as st
from turnspark.sources.trials import load_trials
from turnspark.sources.turns import read_turns, standardize_turns


@query(
    "read_turns",
    """SELECT doc_id AS id, length(coalesce(text, '')) AS chars,
       md5(coalesce(text, '')) AS digest FROM documents""",
)
def read_query(spark, sf_dir):
    """The first existing location wins."""
    turns = read_turns(spark, [f"{sf_dir}/absent.parquet", f"{sf_dir}/documents.parquet"])
    turns = standardize_turns(turns.withColumnRenamed("doc_id", "id"))
    return turns.select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(
    "load_trials",
    """SELECT vec_id AS trial, CAST(vec_id % 10 AS INT) AS subject, CAST(label % 4 AS BIGINT) AS y,
       4 AS channels, 16 AS samples, embedding[1]::FLOAT AS first FROM embeddings""",
)
def load_trials_query(spark, sf_dir):
    trials = load_trials(v.trials(spark, sf_dir), range(10))
    return trials.select(
        "trial",
        "subject",
        "y",
        F.size("x").alias("channels"),
        F.size(F.get("x", 0)).alias("samples"),
        F.get(F.get("x", 0), 0).alias("first"),
    )


SQL_RUNS = f"""cut AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label
    ORDER BY md5('{v.SEED}:' || id), id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5)
    THEN 'valid' ELSE 'train' END AS split FROM labelled),
held AS (SELECT * FROM cut WHERE split = 'valid'),
m AS (SELECT 42 AS seed, id, label, prob AS score FROM held
      UNION ALL SELECT 13, id, label, prob_short FROM held)"""


def stored_runs(spark, sf_dir):
    """Two runs with validation and test rows in the layout of the score store."""
    split = stratified_holdout(v.labelled_scores(spark, sf_dir), 0.2, v.SEED)
    held = split.where("split = 'valid'").select("id", "label", "prob", "prob_short", "split")
    test = v.unlabelled_scores(spark, sf_dir).select(
        "id", F.lit(None).cast("int").alias("label"), "prob", "prob_short", F.lit("test").alias("split")
    )
    each = F.array(
        F.struct(F.lit(42).alias("seed"), F.col("prob").alias("prob")),
        F.struct(F.lit(13).alias("seed"), F.col("prob_short").alias("prob")),
    )
    rows = held.unionByName(test).withColumn("e", F.explode(each))
    return rows.select(
        F.lit("common").alias("experiment"), "e.seed", "split", F.col("id").alias("pos"), "id",
        "label", "e.prob",
    )


@query(
    "score_store",
    f"""WITH {v.SQL_BOTH}, {SQL_RUNS},
    p AS (SELECT seed, label, (score >= 0.5)::INT AS pred FROM m), {sql_class_scores('p', 'seed')},
    raw AS (SELECT seed, avg(f1) AS raw_f1 FROM scores_c WHERE tp + fp + fn > 0 GROUP BY seed),
    {sql_sweep('m', PROB_GRID, 'seed')},
    r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY macro_f1 DESC, threshold) AS r
          FROM swept)
    SELECT 'common' AS experiment, seed, round(raw_f1, 6) AS raw_macro_f1,
      round(threshold, 6) AS threshold, round(macro_f1, 6) AS threshold_macro_f1,
      (SELECT count(*) FROM held) AS valid_count, (SELECT count(*) FROM scores) AS test_count
    FROM r JOIN raw USING (seed) WHERE r = 1""".replace(
        "scores AS (SELECT *, CASE WHEN tp", "scores_c AS (SELECT *, CASE WHEN tp"
    ),
)
def store_query(spark, sf_dir):
    """Written to the shared folder, read back, metrics recomputed."""
    path = f"{ensure_checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    st.save_scores(stored_runs(spark, sf_dir), path)
    out = st.seed_metrics(st.load_scores(spark, path))
    rounded = [
        F.round(c, 6).alias(c) for c in ("raw_macro_f1", "threshold", "threshold_macro_f1")
    ]
    return out.select("experiment", "seed", *rounded, "valid_count", "test_count")


def _quality(spark, sf_dir):
    return v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )


def written_labels(spark, sf_dir) -> str:
    """Folder of label parts with every labelled document, in id order."""
    path = f"{ensure_checkpoint_dir(spark)}/labels-{uuid.uuid4().hex}"
    lb.write_labels(_quality(spark, sf_dir), path, "id")
    return path


@query(
    "label_round_trip",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::VARCHAR AS id,
       quality::VARCHAR AS label FROM labels""",
)
def round_trip_query(spark, sf_dir):
    """Written in ordered parts and read back with positions."""
    rows = lb.read_label_files(spark, written_labels(spark, sf_dir))
    return rows.where("not is_first").select("pos", "id", "label")


@query(
    "audit_labels",
    """SELECT 'OK' AS status, count(*) AS n_rows, count(*) FILTER (quality = 0) AS class0,
       count(*) FILTER (quality = 1) AS class1, 0 AS unexpected_ids, 0 AS duplicate_ids,
       0 AS wrong_positions, 0 AS bad_labels, 0 AS missing_ids FROM labels""",
)
def audit_query(spark, sf_dir):
    """The written parts against the positions it should have."""
    ids = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    expected = position_rows(ids, [F.col("id")], "pos")
    audit = lb.audit_labels(spark, written_labels(spark, sf_dir), expected, (0, 1))
    return audit.select(
        "status", "n_rows", "class0", "class1", "unexpected_ids", "duplicate_ids",
        "wrong_positions", "bad_labels", "missing_ids",
    )


@query(
    "load_references",
    """WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::VARCHAR AS id,
                 quality AS q FROM labels)
    SELECT 'main' AS reference, pos, id, q::INT AS label FROM t
    UNION ALL SELECT 'flipped', pos, id, (1 - q)::INT FROM t""",
)
def references_query(spark, sf_dir):
    """Two names over two roots; ``main`` stands in both, a third name and root in none."""
    base = f"{ensure_checkpoint_dir(spark)}/references-{uuid.uuid4().hex}"
    same = _quality(spark, sf_dir)
    flipped = same.withColumn("label", 1 - F.col("label"))
    for rows, name in ((same, "first/main"), (flipped, "second/main"), (flipped, "second/flipped")):
        lb.write_labels(rows, f"{base}/{name}", "id")
    roots = [f"{base}/{name}" for name in ("first", "absent", "second")]
    return lb.load_references(spark, roots, ["main", "flipped", "nowhere"])
