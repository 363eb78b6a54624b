"""Text columns against plain Python definitions."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnspark.functions import text as tx
from turnspark.sources.turns import standardize_turns

SAMPLES = [
    None,
    "",
    "  Hello ,  “World” !",
    "I was going to",
    "Wait...",
    "Can you help me, please?",
    " um well\tUH, it's -",
    "a",
    "héllo wörld 123 x",
    "  \n ",
    "emoji 😀😀 end",
]


def rows(spark, texts=SAMPLES):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def by_id(df, *names):
    return {r["id"]: [r[n] for n in names] for r in df.collect()}


def test_clean_matches_python_strip(spark):
    got = by_id(rows(spark).select("id", tx.clean_text(F.col("text")).alias("t")), "t")
    assert got == {i: [(t or "").strip()] for i, t in enumerate(SAMPLES)}


def test_normalize_examples_and_idempotence(spark):
    once = rows(spark).select("id", tx.normalize_text(F.col("text")).alias("text"))
    got = by_id(once, "text")
    assert got[2] == ['hello, "world"!']
    assert got[0] == [""]
    twice = by_id(once.select("id", tx.normalize_text(F.col("text")).alias("text")), "text")
    assert twice == got


def expected_cues(text):
    """Independent statement of some of the cues."""
    body = (text or "").strip()
    words = re.findall("[a-z0-9']+", body.lower())
    return {
        "log_chars": math.log1p(len(body)),
        "log_words": math.log1p(len(words)),
        "log_stops": math.log1p(sum(body.count(c) for c in ".?!;:")),
        "last_word_trailing": float(bool(words) and words[-1] in tx.TRAILING_WORDS),
        "fillers": float(sum(w in tx.FILLERS for w in words)),
        "few_words": float(len(words) <= 4),
        "few_chars": float(len(body) <= 24),
        "long_words": float(bool(words) and len(body) / len(words) > 6.5),
    }


def test_endpoint_features(spark):
    got = {
        r["id"]: r.asDict()
        for r in rows(spark).select("id", *tx.endpoint_features(F.col("text"))).collect()
    }
    for i, text in enumerate(SAMPLES):
        for name, value in expected_cues(text).items():
            assert got[i][name] == pytest.approx(value), (text, name)
    assert got[3]["last_word_trailing"] == 1 and got[3]["ends_period"] == 0
    assert got[4]["ends_period"] == 1 and got[4]["ends_dash"] == 1 and got[4]["fillers"] == 1
    assert got[5]["starts_request"] == 1 and got[5]["ends_question"] == 1


def python_words(text, low, high):
    words = re.findall(r"\b\w\w+\b", (text or "").lower())
    return sorted(
        " ".join(words[i : i + n])
        for n in range(low, high + 1)
        for i in range(len(words) - n + 1)
    )


def python_chars(text, low, high):
    out = []
    for word in (text or "").lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            if len(padded) <= n:
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return sorted(out)


@pytest.mark.parametrize("low,high", [(1, 2), (1, 3)])
def test_word_ngrams(spark, low, high):
    got = by_id(rows(spark).select("id", tx.word_ngrams(F.col("text"), low, high).alias("g")), "g")
    for i, text in enumerate(SAMPLES):
        assert sorted(got[i][0]) == python_words(text, low, high)


@pytest.mark.parametrize("low,high", [(3, 5), (4, 6), (3, 6)])
def test_char_ngrams(spark, low, high):
    got = by_id(
        rows(spark).select("id", tx.char_wb_ngrams(F.col("text"), low, high).alias("g")), "g"
    )
    for i, text in enumerate(SAMPLES):
        assert sorted(got[i][0]) == python_chars(text, low, high)


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="aB ,.?'\t é-1", max_size=30), min_size=1, max_size=20))
def test_ngrams_of_random_texts(spark, texts):
    got = by_id(
        rows(spark, texts).select(
            "id",
            tx.char_wb_ngrams(F.col("text"), 3, 5).alias("c"),
            tx.word_ngrams(F.col("text"), 1, 2).alias("w"),
        ),
        "c",
        "w",
    )
    for i, text in enumerate(texts):
        assert sorted(got[i][0]) == python_chars(text, 3, 5)
        assert sorted(got[i][1]) == python_words(text, 1, 2)


def test_standardize(spark):
    raw = spark.createDataFrame(
        [("x", None, "1"), ("y", "b", "0")], "sentence string, content string, label string"
    )
    out = standardize_turns(raw, [F.col("sentence")]).orderBy("id").collect()
    assert [(r["id"], r["text"], r["label"]) for r in out] == [(0, "", 1), (1, "b", 0)]
    with pytest.raises(KeyError):
        standardize_turns(spark.range(1))
