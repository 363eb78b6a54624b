"""Turn tables: standardising, text columns, n-grams, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspark.functions.text import (
    ENDPOINT_NAMES,
    char_wb_ngrams,
    clean_text,
    endpoint_features,
    normalize_text,
    word_ngrams,
)
from turnspark.operators import tfidf as tf
from turnspark.operators.splits import stratified_kfold
from turnspark.queries import views as v
from turnspark.queries.registry import query
from turnspark.sources.turns import standardize_turns

SQL_WORD = "[\\p{L}\\p{N}_]{2,}"


@query(
    "standardize_turns",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, coalesce(length(text), 0) AS chars,
              md5(coalesce(text, '')) AS digest, CAST(quality AS INT) AS label
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def standardize_query(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("utterance"))
    labels = v.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("label")
    )
    turns = standardize_turns(docs.join(labels, "doc_id", "left"), [F.col("doc_id")])
    return turns.select(
        "id", F.length("text").alias("chars"), F.md5("text").alias("digest"), "label"
    )


@query(
    "clean_text",
    f"""SELECT doc_id AS id, md5({v.sql_clean('text')}) AS digest,
               length({v.sql_clean('text')}) AS chars FROM documents""",
)
def clean_query(spark, sf_dir):
    cleaned = clean_text(F.col("text"))
    return v.documents(spark, sf_dir).select(
        "id", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("chars")
    )


@query(
    "normalize_text",
    f"""SELECT doc_id AS id, md5({v.sql_normalize('text')}) AS digest,
               length({v.sql_normalize('text')}) AS chars FROM documents""",
)
def normalize_query(spark, sf_dir):
    value = normalize_text(F.col("text"))
    return v.documents(spark, sf_dir).select(
        "id", F.md5(value).alias("digest"), F.length(value).alias("chars")
    )


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "endpoint_features",
    "WITH docs AS (SELECT doc_id AS id, text FROM documents),"
    + v.sql_features("docs", "f")
    + f" SELECT id, {_rounded(ENDPOINT_NAMES)} FROM f",
)
def endpoint_query(spark, sf_dir):
    docs = v.documents(spark, sf_dir).select("id", *endpoint_features(F.col("text")))
    return docs.select("id", *[F.round(n, 6).alias(n) for n in ENDPOINT_NAMES])


@query(
    "endpoint_features_turns",
    "WITH short AS (SELECT conv_id * 100000 + turn AS id, text FROM conversations),"
    + v.sql_features("short", "f")
    + f" SELECT id, {_rounded(ENDPOINT_NAMES)} FROM f",
)
def endpoint_turns_query(spark, sf_dir):
    rows = v.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), *endpoint_features(F.col("text"))
    )
    return rows.select("id", *[F.round(n, 6).alias(n) for n in ENDPOINT_NAMES])


def _gram_profile(df):
    """Per row: n-grams with repeats, distinct n-grams and a weighted checksum."""
    return df.groupBy("id").agg(
        F.sum("c").alias("n_grams"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("c") * F.col("c")).alias("sum_squares"),
        F.sum(F.col("c") * F.length("term")).alias("sum_chars"),
        F.max("term").alias("last_term"),
    )


SQL_PROFILE = """counted AS (SELECT id, term, count(*) AS c FROM grams GROUP BY id, term)
SELECT id, sum(c)::BIGINT AS n_grams, count(*) AS n_distinct, sum(c * c)::BIGINT AS sum_squares,
       sum(c * length(term))::BIGINT AS sum_chars, max(term) AS last_term
FROM counted GROUP BY id"""

SQL_WORDS = f"""toks AS (SELECT doc_id AS id,
    regexp_extract_all(lower(text), '{SQL_WORD}') AS a FROM documents)"""


def sql_word_grams(high: int) -> str:
    parts = ["SELECT id, unnest(a) AS term FROM toks"]
    for n in range(2, high + 1):
        parts.append(
            f"""SELECT id, unnest(list_transform(range(1, len(a) - {n} + 2),
                lambda i: array_to_string(a[i:i + {n} - 1], ' '))) AS term FROM toks
                WHERE len(a) >= {n}"""
        )
    return "grams AS (" + " UNION ALL ".join(parts) + ")"


@query("word_ngrams", f"WITH {SQL_WORDS}, {sql_word_grams(3)}, {SQL_PROFILE}")
def word_ngrams_query(spark, sf_dir):
    docs = v.documents(spark, sf_dir)
    return _gram_profile(tf.term_counts(docs, word_ngrams(F.col("text"), 1, 3)))


def sql_char_grams(source: str, low: int, high: int, lowered: bool = True) -> str:
    text = "lower(text)" if lowered else "text"
    parts = []
    for n in range(low, high + 1):
        parts.append(
            f"""SELECT id, unnest(list_transform(range(1, greatest(length(w) - {n} + 1, 1) + 1),
                lambda i: substring(w, i, {n}))) AS term FROM padded
                {'' if n == low else f'WHERE length(w) >= {n}'}"""
        )
    return (
        f"""padded AS (SELECT id, ' ' || unnest(list_filter(string_split_regex({text}, '[{v.WS}]+'),
            lambda x: x <> '')) || ' ' AS w FROM {source}),
        grams AS ("""
        + " UNION ALL ".join(parts)
        + ")"
    )


@query(
    "char_wb_ngrams",
    f"""WITH src AS (SELECT doc_id AS id, text FROM documents),
        {sql_char_grams('src', 3, 5)}, {SQL_PROFILE}""",
)
def char_ngrams_query(spark, sf_dir):
    docs = v.documents(spark, sf_dir)
    return _gram_profile(tf.term_counts(docs, char_wb_ngrams(F.col("text"), 3, 5)))


SQL_TFIDF = f"""WITH toks AS (SELECT doc_id AS id,
    regexp_extract_all(lower(text), '{SQL_WORD}') AS a FROM documents JOIN labels USING (doc_id)),
{sql_word_grams(2)},
counts AS (SELECT id, term, count(*) AS c FROM grams GROUP BY id, term),
n AS (SELECT count(*)::DOUBLE AS n FROM toks),
vocab AS (SELECT term, count(*) AS df, sum(c)::BIGINT AS total,
          ln((1.0 + (SELECT n FROM n)) / (count(*) + 1.0)) + 1.0 AS idf
          FROM counts GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT id, term, (1.0 + ln(c)) * idf AS w FROM counts JOIN vocab USING (term)),
unit AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)
"""


@query(
    "tfidf",
    SQL_TFIDF
    + """SELECT id, count(*) AS n_terms, round(sum(w), 5) AS sum_w, round(max(w), 6) AS max_w,
         round(min(w), 6) AS min_w FROM unit GROUP BY id""",
)
def tfidf_query(spark, sf_dir):
    weights = tf.tfidf(v.turns(spark, sf_dir), word_ngrams(F.col("text"), 1, 2), min_df=2)
    return weights.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.sum("w"), 5).alias("sum_w"),
        F.round(F.max("w"), 6).alias("max_w"),
        F.round(F.min("w"), 6).alias("min_w"),
    )


@query(
    "tfidf_vocabulary",
    SQL_TFIDF + "SELECT term, df, total, round(idf, 6) AS idf FROM vocab",
)
def vocabulary_query(spark, sf_dir):
    turns = v.turns(spark, sf_dir)
    counts = tf.term_counts(turns, word_ngrams(F.col("text"), 1, 2))
    vocab = tf.vocabulary(counts, turns.count(), 2)
    return vocab.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_max_features",
    SQL_TFIDF
    + """SELECT term, df, total, round(idf, 6) AS idf FROM vocab
         ORDER BY total DESC, term LIMIT 500""",
)
def max_features_query(spark, sf_dir):
    turns = v.turns(spark, sf_dir)
    counts = tf.term_counts(turns, word_ngrams(F.col("text"), 1, 2))
    vocab = tf.vocabulary(counts, turns.count(), 2, 500)
    return vocab.select("term", "df", "total", F.round("idf", 6).alias("idf"))


SQL_FOLDS = f"""folds AS (SELECT id, text, label, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5('{v.SEED}:' || id), id) - 1) % {v.FOLDS} AS INT) AS fold FROM turns)"""


@query(
    "fold_document_frequency",
    f"""WITH {v.SQL_TURNS}, {SQL_FOLDS},
    terms AS (SELECT DISTINCT id, fold,
              unnest(regexp_extract_all(lower(text), '{SQL_WORD}')) AS term FROM folds),
    held AS (SELECT DISTINCT fold AS f FROM folds)
    SELECT held.f AS fold, term, count(*) AS train_df FROM terms JOIN held ON terms.fold <> held.f
    GROUP BY held.f, term""",
)
def fold_df_query(spark, sf_dir):
    folds = stratified_kfold(v.turns(spark, sf_dir), v.FOLDS, v.SEED)
    return tf.fold_document_frequency(folds, word_ngrams(F.col("text"), 1, 1))


CUES = ["log_chars", "log_words", "log_commas", "log_stops", "conjunctions", "ends_question"]


@query(
    "standard_scale",
    f"""WITH {v.SQL_TURNS}, {v.sql_features('turns', 'f')} SELECT id, """
    + ", ".join(
        f"""round({c} / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER ()
            ELSE 1 END, 6) AS z_{c}"""
        for c in CUES
    )
    + " FROM f",
)
def standard_scale_query(spark, sf_dir):
    features = v.turns(spark, sf_dir).select("id", *endpoint_features(F.col("text")))
    scaled = tf.standard_scale(features.select("id", *CUES), CUES, with_mean=False)
    return scaled.select("id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in CUES])


@query(
    "standard_scale_centred",
    f"""WITH {v.SQL_DIMS} SELECT id, round(sum(z), 5) AS sum_z, round(max(z), 6) AS max_z,
        round(min(z), 6) AS min_z FROM (SELECT id, (v - avg(v) OVER (PARTITION BY i))
        / stddev_pop(v) OVER (PARTITION BY i) AS z FROM dims) GROUP BY id""",
)
def standard_scale_centred_query(spark, sf_dir):
    names = [f"e{i}" for i in range(64)]
    wide = v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)],
    )
    scaled = tf.standard_scale(wide, names, with_mean=True)
    cells = F.array(*[f"z_{n}" for n in names])
    return scaled.select(
        "id",
        F.round(F.aggregate(cells, F.lit(0.0), lambda s, x: s + x), 5).alias("sum_z"),
        F.round(F.array_max(cells), 6).alias("max_z"),
        F.round(F.array_min(cells), 6).alias("min_z"),
    )
