"""The physical plans that the operators are written for."""

import re

from pyspark.sql import functions as F

from turnspark.functions.text import endpoint_features, word_ngrams
from turnspark.operators import ensemble as en
from turnspark.operators import metrics as m
from turnspark.operators import tfidf as tf
from turnspark.skew import lookup_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan(df)))


def turns(spark, tmp_path):
    path = str(tmp_path / "turns")
    rows = [(i, f"text number {i}", i % 2, "unused") for i in range(50)]
    spark.createDataFrame(rows, "id long, text string, label int, extra string").write.parquet(path)
    return spark.read.parquet(path)


def test_cue_features_need_no_shuffle_and_no_python(spark, tmp_path):
    df = turns(spark, tmp_path).select("id", *endpoint_features(F.col("text")))
    text = plan(df)
    assert exchanges(df) == 0 and "Python" not in text
    assert "ReadSchema: struct<id:bigint,text:string>" in text


def test_term_counts_shuffle_texts_once(spark, tmp_path):
    counts = tf.term_counts(turns(spark, tmp_path), word_ngrams(F.col("text"), 1, 2))
    assert exchanges(counts) == 1


def test_pair_counts_combine_before_the_shuffle(spark, tmp_path):
    df = turns(spark, tmp_path).withColumn("pred", F.lit(1))
    text = plan(m.pair_counts(df))
    assert "partial_count" in text and "struct<label:int>" in text


def test_gate_keeps_k_rows_per_task(spark):
    pairs = spark.range(1000).select(
        "id",
        F.lit(0).alias("strong_label"),
        F.rand(1).alias("confidence"),
        F.lit(1).alias("diverse_label"),
    )
    text = plan(en.confidence_gate(pairs, 5))
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text


def test_topk_limits_groups_before_the_shuffle(spark):
    sim = spark.range(1000).select(
        (F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.rand(1).alias("similarity")
    )
    assert "WindowGroupLimit" in plan(en.topk_per_row(sim, 5, "a", "b"))


def test_lookup_join_salts_by_hash(spark):
    rows = spark.range(100).select("id", F.lit("k").alias("k"))
    lookup = spark.createDataFrame([("k", 1)], "k string, v int")
    joined = lookup_join(rows, lookup, ["k"], ["id"], salts=8)
    assert joined.count() == 100 and joined.columns == ["k", "id", "v"]
    assert "CartesianProduct" not in plan(joined) and "NestedLoop" not in plan(joined)
