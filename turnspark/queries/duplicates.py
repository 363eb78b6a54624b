"""Duplicate transfer, validation and comparison of label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspark.functions.scores import labels_from_scores
from turnspark.lineage import cut_lineage
from turnspark.operators import compare as cp
from turnspark.operators import duplicates as du
from turnspark.operators import near as nr
from turnspark.operators import thresholds as th
from turnspark.operators.splits import stratified_holdout
from turnspark.plans.candidates import as_json, run_summary
from turnspark.queries import views as v
from turnspark.queries.metrics import PROB_GRID, sql_sweep
from turnspark.queries.registry import query
from turnspark.ranking import position_rows


def train_table(spark, sf_dir):
    return v.turns(spark, sf_dir).withColumn("pos", F.col("id"))


def base_labels(spark, sf_dir):
    scores = v.unlabelled_scores(spark, sf_dir)
    return scores.select("id", labels_from_scores(F.col("prob"), 0.7).alias("label"), "prob")


SQL_BASE = f"""{v.SQL_UNLABELLED},
base AS (SELECT id, (prob >= 0.7::DOUBLE)::INT AS label, prob FROM scores),
tr AS (SELECT id, label, sha256({v.sql_normalize('text')}) AS key FROM turns),
te AS (SELECT id, sha256({v.sql_normalize('text')}) AS key FROM unlab),
g AS (SELECT key, count(*) AS n_train, min(label) AS low, max(label) AS high,
      min(id) AS first_train_id FROM tr GROUP BY key),
report AS (SELECT te.id AS test_id, key, n_train, first_train_id, 1.0::DOUBLE AS similarity,
    low = high AS unanimous, base.label AS old_label,
    CASE WHEN low = high THEN low ELSE base.label END AS new_label, prob,
    low = high AND low <> base.label AS applied FROM te JOIN g USING (key) JOIN base ON base.id = te.id)"""


def report(spark, sf_dir):
    return du.exact_duplicate_transfer(
        train_table(spark, sf_dir), v.unlabelled(spark, sf_dir), base_labels(spark, sf_dir)
    )


@query("exact_duplicate_transfer", f"WITH {SQL_BASE} SELECT * FROM report")
def exact_query(spark, sf_dir):
    return report(spark, sf_dir)


@query(
    "exact_duplicate_members",
    f"""WITH {SQL_BASE} SELECT key, id AS train_id, id AS pos, label FROM tr
        WHERE key IN (SELECT key FROM te)""",
)
def members_query(spark, sf_dir):
    return du.matched_members(train_table(spark, sf_dir), v.unlabelled(spark, sf_dir))


@query(
    "transfer_summary",
    f"""WITH {SQL_BASE} SELECT count(*) AS exact_matches, count(*) FILTER (NOT unanimous) AS conflicts,
        count(*) FILTER (applied) AS override_candidates, count(*) FILTER (applied) AS applied_overrides
        FROM report""",
)
def summary_query(spark, sf_dir):
    return du.transfer_summary(report(spark, sf_dir))


@query(
    "apply_overrides",
    f"""WITH {SQL_BASE} SELECT base.id, coalesce(r.new_label, base.label) AS label, base.prob
        FROM base LEFT JOIN (SELECT * FROM report WHERE applied) r ON r.test_id = base.id""",
)
def overrides_query(spark, sf_dir):
    applied = report(spark, sf_dir).where("applied")
    overrides = applied.select(
        F.col("test_id").alias("id"), "new_label", F.lit("exact").alias("match_type")
    )
    return du.apply_overrides(base_labels(spark, sf_dir), overrides)


def candidates(spark, sf_dir):
    """Three label tables over the unlabelled turns."""
    scores = v.unlabelled_scores(spark, sf_dir)
    each = F.array(
        F.struct(
            F.lit("full").alias("candidate"),
            labels_from_scores(F.col("prob"), 0.7).alias("label"),
        ),
        F.struct(
            F.lit("short").alias("candidate"),
            labels_from_scores(F.col("prob_short"), 0.7).alias("label"),
        ),
        F.struct(
            F.lit("mean").alias("candidate"),
            labels_from_scores((F.col("prob") + F.col("prob_short")) / 2, 0.7).alias("label"),
        ),
    )
    rows = scores.select("id", F.explode(each).alias("e")).select("e.candidate", "id", "e.label")
    return cut_lineage(rows)  # label tables are stored tables


SQL_CANDIDATES = f"""{v.SQL_UNLABELLED},
cands AS (SELECT 'full' AS candidate, id, (prob >= 0.7::DOUBLE)::INT AS label FROM scores
  UNION ALL SELECT 'short', id, (prob_short >= 0.7::DOUBLE)::INT FROM scores
  UNION ALL SELECT 'mean', id, ((prob + prob_short) / 2 >= 0.7::DOUBLE)::INT FROM scores)"""


def references(rows):
    kept = rows.where("candidate <> 'mean'")
    return kept.select(F.col("candidate").alias("reference"), "id", "label")


@query(
    "compare_labels",
    f"""WITH {SQL_CANDIDATES},
    refs AS (SELECT candidate AS reference, id, label AS ref_label FROM cands WHERE candidate <> 'mean'),
    pairs AS (SELECT c.candidate, r.reference, count(*) AS n_rows,
              count(*) FILTER (label <> ref_label) AS hamming
              FROM cands c JOIN refs r USING (id) GROUP BY ALL),
    names AS (SELECT DISTINCT candidate, unnest(['full', 'short', 'lost']) AS reference FROM cands)
    SELECT candidate, reference, n_rows, hamming, hamming = 0 AS identical
    FROM names LEFT JOIN pairs USING (candidate, reference)""",
)
def compare_query(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return cp.compare_labels(rows, references(rows), ["full", "short", "lost"])


@query(
    "changed_rows",
    f"""WITH {SQL_CANDIDATES}, refs AS (SELECT candidate AS reference, id, label AS ref_label
        FROM cands WHERE candidate <> 'mean') SELECT id, candidate, label, reference, ref_label
        FROM cands JOIN refs USING (id) WHERE label <> ref_label""",
)
def changed_query(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return cp.changed_rows(rows, references(rows))


@query(
    "row_comparison",
    f"""WITH {SQL_CANDIDATES} SELECT c.candidate, c.id, c.label, r.label AS ref_label,
        r.label IS NOT NULL AS changed FROM cands c LEFT JOIN cands r
        ON r.id = c.id AND r.candidate = 'full' WHERE r.label IS NULL OR r.label <> c.label""",
)
def row_comparison_query(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return cp.row_comparison(rows, rows.where("candidate = 'full'").select("id", "label"))


def submission(spark, sf_dir):
    """The labels table as a submission for all documents: incomplete, with a narrow domain."""
    labels = v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("label"),
    )
    return position_rows(labels, [F.col("id")])


def expected(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return position_rows(docs, [F.col("id")])


@query(
    "validate_labels",
    """WITH sub AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label,
        row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels),
    want AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT 'missing_id' AS rule, id::VARCHAR AS id, '' AS detail FROM want
      WHERE id NOT IN (SELECT id FROM sub)
    UNION ALL SELECT 'unexpected_id', id::VARCHAR, '' FROM sub WHERE id NOT IN (SELECT id FROM want)
    UNION ALL SELECT 'duplicate_id', id::VARCHAR, count(*)::VARCHAR FROM sub GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'wrong_position', sub.id::VARCHAR, sub.pos || '/' || want.pos FROM sub
      JOIN want ON sub.id = want.id WHERE sub.pos <> want.pos
    UNION ALL SELECT 'outside_domain', id::VARCHAR, label::VARCHAR FROM sub WHERE label NOT IN (0, 1)
    UNION ALL SELECT 'row_count', '', a || '/' || b FROM (SELECT count(*) AS a FROM sub),
      (SELECT count(*) AS b FROM want) WHERE a <> b""",
)
def validate_query(spark, sf_dir):
    return cp.validate_labels(submission(spark, sf_dir), expected(spark, sf_dir), (0, 1))


@query(
    "domain_diff",
    """WITH seen AS (SELECT DISTINCT lang AS value FROM documents),
       want AS (SELECT unnest(['en', 'fr', 'it']) AS value)
       SELECT value, 'unexpected' AS side FROM seen WHERE value NOT IN (SELECT value FROM want)
       UNION ALL SELECT value, 'absent' FROM want WHERE value NOT IN (SELECT value FROM seen)""",
)
def domain_query(spark, sf_dir):
    return cp.domain_diff(v.table(spark, sf_dir, "documents"), "lang", ["en", "fr", "it"])


def validation_sequence(spark, sf_dir, seed):
    labels = v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    split = stratified_holdout(labels, 0.2, seed)
    return position_rows(split.where("split = 'valid'").select("id"), [F.col("id")])


def _sql_sequence(name, seed):
    return f"""{name} AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT doc_id AS id,
    row_number() OVER (PARTITION BY quality ORDER BY md5('{seed}:' || doc_id), doc_id) AS r,
    count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE r <= floor(n * 0.2::DOUBLE + 0.5))"""


@query(
    "same_split",
    f"""WITH {_sql_sequence('a', 42)}, {_sql_sequence('b', 13)} SELECT count(*) AS positions,
        count(*) FILTER (a.id IS DISTINCT FROM b.id) AS mismatches,
        count(*) FILTER (a.id IS DISTINCT FROM b.id) = 0 AS same
        FROM a FULL JOIN b USING (pos)""",
)
def same_split_query(spark, sf_dir):
    return cp.same_split(
        validation_sequence(spark, sf_dir, 42), validation_sequence(spark, sf_dir, 13)
    )


@query(
    "concat",
    """SELECT 'labelled' AS part, doc_id AS id FROM labels UNION ALL
       SELECT 'all', doc_id FROM documents""",
)
def concat_query(spark, sf_dir):
    a = v.table(spark, sf_dir, "labels").select(
        F.lit("labelled").alias("part"), F.col("doc_id").alias("id")
    )
    b = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("all").alias("part")
    )
    return a.unionByName(b)


@query(
    "first_n",
    f"""WITH {SQL_BASE} SELECT test_id, key, prob FROM report ORDER BY test_id LIMIT 50""",
)
def first_n_query(spark, sf_dir):
    """The first 50 duplicate hits in test order."""
    return report(spark, sf_dir).select("test_id", "key", "prob").orderBy("test_id").limit(50)


@query(
    "run_summary",
    f"""WITH {v.SQL_BOTH}, base AS (SELECT id, (prob >= 0.7::DOUBLE)::INT AS label FROM scores),
    {SQL_BASE.split('tr AS', 1)[1].join(['tr AS', ''])}
    SELECT (SELECT count(*) FROM turns) AS train_rows,
      (SELECT count(*) FROM turns WHERE label = 0) AS train_label0,
      (SELECT count(*) FROM turns WHERE label = 1) AS train_label1,
      (SELECT count(*) FROM unlab) AS test_rows, count(*) AS exact_matches,
      count(*) FILTER (NOT unanimous) AS conflicts, count(*) FILTER (applied) AS override_candidates,
      count(*) FILTER (applied) AS applied_overrides FROM report""".replace("prob,\n    low", "0 AS prob,\n    low"),
)
def run_summary_query(spark, sf_dir):
    shapes = ["train_rows", "train_label0", "train_label1", "test_rows"]
    return whole_summary(spark, sf_dir).select(*shapes, "transfer.*")


@query(
    "run_summary_members",
    f"""WITH {v.SQL_LABELLED},
    m AS (SELECT 'full' AS name, id, label, prob AS score FROM labelled
          UNION ALL SELECT 'short', id, label, prob_short FROM labelled),
    {sql_sweep('m', PROB_GRID, 'name')},
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY macro_f1 DESC, threshold) AS r FROM swept)
    SELECT (SELECT count(*) FROM turns) AS train_rows, name, round(threshold, 6) AS threshold,
      round(macro_f1, 6) AS tuned_f1 FROM r WHERE r = 1""",
)
def summary_members_query(spark, sf_dir):
    """The members of the summary, read back from its JSON document."""
    summary = whole_summary(spark, sf_dir)
    read = as_json(summary).select(F.from_json("summary", summary.schema).alias("s"))
    rows = read.select("s.train_rows", F.explode("s.members").alias("m"))
    rounded = [F.round(f"m.{c}", 6).alias(c) for c in ("threshold", "tuned_f1")]
    return rows.select("train_rows", "m.name", *rounded)


def whole_summary(spark, sf_dir):
    """Shapes, two tuned members and transfer counts as one nested row."""
    scores = v.labelled_scores(spark, sf_dir)
    named = F.array(
        F.struct(F.lit("full").alias("name"), "prob"),
        F.struct(F.lit("short").alias("name"), F.col("prob_short").alias("prob")),
    )
    each = scores.select("id", "label", F.explode(named).alias("m")).select("id", "label", "m.*")
    members = th.tune_threshold_probs(each, "prob", by=["name"]).select(
        "name", "threshold", F.col("macro_f1").alias("tuned_f1")
    )
    return run_summary(
        v.turns(spark, sf_dir), v.unlabelled(spark, sf_dir), members, report(spark, sf_dir)
    )


@query("near_duplicate_transfer")
def near_query(spark, sf_dir):
    """Whole texts of both tables at the strict default ratio."""
    test = v.unlabelled(spark, sf_dir).withColumn("pos", F.col("id"))
    return nr.near_duplicate_transfer(
        train_table(spark, sf_dir), test, base_labels(spark, sf_dir)
    )


@query("near_duplicate_matches")
def near_loose_query(spark, sf_dir):
    """All near matches at a looser ratio, with ratio and cosine."""
    test = v.unlabelled(spark, sf_dir).withColumn("pos", F.col("id"))
    return nr.near_matches(train_table(spark, sf_dir), test, min_ratio=0.95)
