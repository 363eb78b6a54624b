"""The given tables seen as turns, score tables, trials and probability tables.

Each view exists twice: as a DataFrame and as SQL text for the twin queries.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnspark.functions.binding import bind
from turnspark.functions.scores import array_sum, linear_score, logistic, softmax
from turnspark.functions.text import (
    CONJUNCTIONS,
    CUE_TOKEN,
    ENDPOINT_NAMES,
    FILLERS,
    REQUEST_PREFIXES,
    TRAILING_WORDS,
    endpoint_features,
)
from turnspark.operators.ensemble import paired_outputs

SEED = 42
FOLDS = 5
CLASSES = 10

# A fixed linear scorer over the cue columns: the stand-in for a trained model.
CUE_WEIGHTS = [
    0.55, -0.35, 0.25, -0.45, 0.40, 0.30, -0.20, -0.60, -0.50, -0.40,
    0.35, 0.10, -0.15, -0.25, 0.05, -0.70, -0.30, 0.20,
]
CUE_INTERCEPT = -0.55
SHORT_WEIGHTS = [
    0.30, -0.10, 0.05, -0.20, 0.60, 0.10, -0.10, -0.40, -0.30, -0.20,
    0.15, 0.20, -0.10, -0.05, 0.02, -0.90, -0.50, 0.10,
]
SHORT_INTERCEPT = -0.80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- turns


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text. A table of fewer splits than cores is hashed over the cores first."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "id") if docs.rdd.getNumPartitions() < cores else docs


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, label: the documents that carry a quality label."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    return documents(spark, sf_dir).join(labels, "id").select("id", "text", "label")


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return documents(spark, sf_dir).join(labels, "id", "left_anti")


def cue_prob(weights=CUE_WEIGHTS, intercept=CUE_INTERCEPT) -> Column:
    """Probability of the fixed scorer, rounded so that every engine sees the same value."""
    columns = [F.col(n) for n in ENDPOINT_NAMES]
    return F.round(logistic(linear_score(columns, weights, intercept)), 6)


def scored(turn_table: DataFrame) -> DataFrame:
    """id, (label,) prob by the full scorer and prob_short by a second one."""
    keep = [c for c in ("id", "label") if c in turn_table.columns]
    features = turn_table.select(*keep, *endpoint_features(F.col("text")))
    return features.select(
        *keep, cue_prob().alias("prob"), cue_prob(SHORT_WEIGHTS, SHORT_INTERCEPT).alias("prob_short")
    )


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(turns(spark, sf_dir))


def unlabelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(unlabelled(spark, sf_dir))


WS = (
    "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_clean(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_normalize(text: str) -> str:
    value = sql_clean(f"lower({text})")
    value = f"translate({value}, '‘’“”', '''''\"\"')"
    value = f"regexp_replace({value}, '[{WS}]+', ' ', 'g')"
    return f"regexp_replace({value}, '[{WS}]+([,.!?;:])', '\\1', 'g')"


SQL_TURNS = """
turns AS (SELECT d.doc_id AS id, d.text, l.quality AS label
          FROM documents d JOIN labels l USING (doc_id)),
unlab AS (SELECT d.doc_id AS id, d.text FROM documents d
          WHERE d.doc_id NOT IN (SELECT doc_id FROM labels))
"""


def sql_features(source: str, name: str, extra: str = "") -> str:
    """CTEs computing the 18 cue columns of ``source`` (id, text, extra columns)."""
    starts = " OR ".join(f"starts_with(low, '{p}')" for p in REQUEST_PREFIXES)

    def hits(words: list[str]) -> str:
        return f"len(list_filter(toks, lambda x: x IN ({_quoted(words)})))::DOUBLE"

    def drop(chars: str) -> str:
        return f"(length(body) - length(translate(body, '{chars}', '')))"

    return f"""
{name}_a AS (SELECT id{extra}, {sql_clean('text')} AS body FROM {source}),
{name}_b AS (SELECT *, lower(body) AS low FROM {name}_a),
{name}_c AS (SELECT *, regexp_extract_all(low, '{CUE_TOKEN.replace("'", "''")}') AS toks FROM {name}_b),
{name} AS (SELECT id{extra},
  ln(1 + length(body)) AS log_chars,
  ln(1 + len(toks)) AS log_words,
  ln(1 + {drop(',')}) AS log_commas,
  ln(1 + {drop('.?!;:')}) AS log_stops,
  (suffix(body, '.'))::INT::DOUBLE AS ends_period,
  (suffix(body, '?'))::INT::DOUBLE AS ends_question,
  (suffix(body, '!'))::INT::DOUBLE AS ends_exclamation,
  (suffix(body, ','))::INT::DOUBLE AS ends_comma,
  (suffix(body, '-') OR suffix(body, '...'))::INT::DOUBLE AS ends_dash,
  (len(toks) > 0 AND toks[-1] IN ({_quoted(TRAILING_WORDS)}))::INT::DOUBLE AS last_word_trailing,
  ({starts})::INT::DOUBLE AS starts_request,
  (contains(body, '?'))::INT::DOUBLE AS has_question,
  (contains(body, ','))::INT::DOUBLE AS has_comma,
  {hits(FILLERS)} AS fillers,
  {hits(CONJUNCTIONS)} AS conjunctions,
  (len(toks) <= 4)::INT::DOUBLE AS few_words,
  (length(body) <= 24)::INT::DOUBLE AS few_chars,
  (len(toks) > 0 AND length(body) / len(toks)::DOUBLE > 6.5)::INT::DOUBLE AS long_words
  FROM {name}_c)"""


def _sql_prob(weights, intercept) -> str:
    terms = f"({intercept}::DOUBLE"
    for name, weight in zip(ENDPOINT_NAMES, weights):
        terms = f"{terms} + {name} * ({weight}::DOUBLE)"
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-{terms}))), 6)"


def sql_scored(source: str, name: str, extra: str = "") -> str:
    return (
        sql_features(source, f"{name}_f", extra)
        + f""",
{name} AS (SELECT id{extra}, {_sql_prob(CUE_WEIGHTS, CUE_INTERCEPT)} AS prob,
  {_sql_prob(SHORT_WEIGHTS, SHORT_INTERCEPT)} AS prob_short FROM {name}_f)"""
    )


SQL_LABELLED = SQL_TURNS + "," + sql_scored("turns", "labelled", ", label")
SQL_UNLABELLED = SQL_TURNS + "," + sql_scored("unlab", "scores")
SQL_BOTH = SQL_LABELLED + "," + sql_scored("unlab", "scores")


# ---------------------------------------------------------------- trials


def trials(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """subject, trial, y and x (channels x time) from the 64 numbers of each embedding."""
    size = 64 // channels
    x = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.slice("embedding", c * size + 1, size).cast("array<double>"),
    )
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).cast("int").alias("subject"),
        F.col("vec_id").alias("trial"),
        (F.col("label") % 4).cast("int").alias("y"),
        x.alias("x"),
    )


SQL_SAMPLES = """
cells AS (SELECT vec_id AS trial, CAST(vec_id % 10 AS INT) AS subject, CAST(label % 4 AS INT) AS y,
                 unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
samples AS (SELECT trial, subject, y, CAST(i // 16 AS INT) AS ch, CAST(i % 16 AS INT) AS t, v
            FROM cells)
"""

SQL_WINDOWS = SQL_SAMPLES + """,
starts AS (SELECT CAST(unnest(range(0, 9, 2)) AS INT) AS start),
windows AS (SELECT s.trial, s.subject, s.y, s.ch, w.start, s.t - w.start AS t, s.v
            FROM samples s JOIN starts w ON s.t >= w.start AND s.t < w.start + 8)
"""


# ---------------------------------------------------------------- probability tables


def _keep_dims(values: Column, part: int | None) -> Column:
    if part is None:
        return values
    return F.filter(values, lambda _, i: i % 3 == part)


def class_centroids(embeddings: DataFrame) -> list[list[float]]:
    """Mean embedding of every class of the closed domain 0..CLASSES-1."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    rows = (
        embeddings.where(F.col("label").between(0, CLASSES - 1))
        .groupBy("label")
        .agg(vector_to_array(Summarizer.mean(vector)).alias("c"))
    )
    return [r["c"] for r in rows.orderBy("label").collect()]


def centroid_probs(centroids: list[list[float]], part: int | None, digits: int = 6) -> Column:
    """Softmax of minus the squared distance of ``embedding`` to every class centroid.

    ``part`` restricts the distance to the dimensions i with i % 3 == part.
    """
    kept = [[x for i, x in enumerate(c) if part is None or i % 3 == part] for c in centroids]
    constant = F.from_json(F.lit(json.dumps(kept)), "array<array<double>>")
    point = _keep_dims(F.col("embedding").cast("array<double>"), part)

    def distances(x: Column) -> Column:
        return F.transform(
            constant,
            lambda c: -array_sum(F.zip_with(x, c, lambda a, b: (a - b) * (a - b))),
        )

    return F.transform(softmax(bind(point, distances)), lambda p: F.round(p, digits))


MODELS = ["strong", "diverse1", "diverse2", "diverse3"]


def model_probs(spark: SparkSession, sf_dir: str, models: Sequence[str] = MODELS) -> DataFrame:
    """Rows (model, id, y, probs) of the probability tables, from one scan."""
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = class_centroids(embeddings)
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                centroid_probs(
                    centroids, None if name == "strong" else int(name[-1]) - 1
                ).alias("probs"),
            )
            for name in models
        ]
    )
    return embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), F.explode(each).alias("e")
    ).select("e.model", "id", "y", "e.probs")


def strong_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_probs(spark, sf_dir, ["strong"]).drop("model")


def _sql_probs(name: str, part: int | None) -> str:
    where = "" if part is None else f"WHERE c.i % 3 = {part}"
    return f"""
{name}_l AS (SELECT c.id, c.y, m.cls, -sum((c.v - m.v) * (c.v - m.v)) AS z
  FROM dims c JOIN means m ON c.i = m.i {where} GROUP BY c.id, c.y, m.cls),
{name}_e AS (SELECT id, y, cls, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM {name}_l),
{name} AS (SELECT id, y, cls, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM {name}_e)"""


SQL_DIMS = """
dims AS (SELECT vec_id AS id, label AS y, unnest(range(0, 64)) AS i,
                unnest(embedding)::DOUBLE AS v FROM embeddings),
means AS (SELECT y AS cls, i, avg(v) AS v FROM dims GROUP BY y, i)"""

SQL_STRONG = SQL_DIMS + "," + _sql_probs("strong", None)
SQL_MODELS = (
    SQL_STRONG
    + "".join("," + _sql_probs(f"diverse{p + 1}", p) for p in range(3))
    + """,
probs AS (SELECT 'strong' AS model, * FROM strong UNION ALL SELECT 'diverse1', * FROM diverse1
          UNION ALL SELECT 'diverse2', * FROM diverse2 UNION ALL SELECT 'diverse3', * FROM diverse3)
"""
)

SQL_PAIRS = (
    SQL_STRONG
    + ","
    + _sql_probs("diverse1", 0)
    + """,
s_best AS (SELECT id, y, arg_max(cls, (p, -cls)) AS strong_label, max(p) AS confidence
           FROM strong GROUP BY id, y),
d_best AS (SELECT id, arg_max(cls, (p, -cls)) AS diverse_label FROM diverse1 GROUP BY id),
pairs AS (SELECT * FROM s_best JOIN d_best USING (id))"""
)


def gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a strong and a diverse model with the truth, one row per id."""
    probs = model_probs(spark, sf_dir, ["strong", "diverse1"])
    strong, diverse = (probs.where(F.col("model") == n) for n in ("strong", "diverse1"))
    return paired_outputs(strong, diverse, keep=["y"])
