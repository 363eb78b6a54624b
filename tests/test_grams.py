"""n-grams counted from words in tasks: the same rows as those of the exploded arrays."""

import pytest
from pyspark.sql import functions as F

from turnspark.functions import grams as gr
from turnspark.functions.text import char_wb_ngrams, clean_text, word_ngrams
from turnspark.operators import tfidf as tf

TEXTS = ["A bb ccc dddd eeeeeee é", "a BB xx ccc ccc a bb", "", None, " \t ", "one", "x" * 40 + " y", "日本 語 a_b 9z", "it's so-so, so so"]


@pytest.mark.parametrize("tokens", [3, 1 << 18])
@pytest.mark.parametrize("of", [lambda t: word_ngrams(t, 1, 3), lambda t: word_ngrams(t, 2, 2), lambda t: char_wb_ngrams(t, 3, 5), lambda t: char_wb_ngrams(clean_text(t), 2, 6, False)])
def test_counts_are_those_of_the_arrays(spark, of, tokens):
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "id long, text string")
    grams = of(F.col("text"))
    found = tf.term_counts(df, grams, tokens=tokens)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = df.select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))
    assert found.dtypes == want.dtypes
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_pieces_of_a_short_word_count_once():
    sizes, numbers, pieces = gr._pieces(["a", "abcd"], 3, 5)
    assert [pieces[i] for i in numbers[: sizes[0]]] == [" a "] and sizes[1] == 4 + 3 + 2
