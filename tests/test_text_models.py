"""TF-IDF, text classifiers and cross-validation."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.functions.text import word_ngrams
from turnspark.models import text_models as tm
from turnspark.operators import ensemble as en
from turnspark.operators import tfidf as tf
from turnspark.operators.splits import stratified_kfold
from turnspark.plans import sweeps as sw

GOOD = ["thanks a lot for the help", "the train leaves at nine", "please open the window now", "we had dinner at home"]
BAD = ["so I was going to", "and then because of the", "um well I think that", "could you maybe get me a"]


def turns(spark, n=6):
    rows = []
    for i in range(n):
        rows += [(f"{t} {'x' * (i % 3)}".strip() + ".", 1) for t in GOOD]
        rows += [(f"{t} {'uh' * (i % 2)}".strip(), 0) for t in BAD[: 2 + i % 3]]
    return spark.createDataFrame(
        [(i, t, y) for i, (t, y) in enumerate(rows)], "id long, text string, label int"
    )


def test_tfidf_matches_definition(spark):
    texts = ["aa bb aa", "bb cc", "aa dd dd dd", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {
        (r["id"], r["term"]): r["w"]
        for r in tf.tfidf(df, word_ngrams(F.col("text"), 1, 1), min_df=2).collect()
    }
    seen = Counter(t for x in texts for t in set(x.split()))
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in seen.items() if n >= 2}
    raw = {"aa": (1 + math.log(2)) * idf["aa"], "bb": idf["bb"]}
    norm = math.hypot(*raw.values())
    assert got[(0, "aa")] == pytest.approx(raw["aa"] / norm)
    assert got[(1, "bb")] == pytest.approx(1.0)
    assert not any(i == 3 for i, _ in got)


def test_fold_statistics_do_not_leak(spark):
    df = stratified_kfold(turns(spark), 3, 1)
    grams = word_ngrams(F.col("text"), 1, 1)
    before = tf.fold_document_frequency(df, grams).where("fold = 1").collect()
    changed = df.withColumn("text", F.when(F.col("fold") == 1, "other words").otherwise(F.col("text")))
    after = tf.fold_document_frequency(changed, grams).where("fold = 1").collect()
    assert sorted(before) == sorted(after)
    scores = df.withColumn("score", F.col("id").cast("double"))
    moved = scores.withColumn("score", F.when(F.col("fold") == 1, -1e6).otherwise(F.col("score")))
    first = en.complement_moments(scores, "score", "fold").where("fold = 1").first()
    second = en.complement_moments(moved, "score", "fold").where("fold = 1").first()
    assert first["mu"] == pytest.approx(second["mu"])


def test_standard_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = tf.standard_scale(df, ["a", "b"], with_mean=True).orderBy("a").collect()
    assert [r["z_a"] for r in rows] == [-1.0, 1.0] and [r["z_b"] for r in rows] == [0.0, 0.0]


@pytest.mark.parametrize("loss,even", [("hinge", "weights"), ("logistic", "copies")])
def test_fit_save_load(spark, tmp_path, loss, even):
    blocks = (tm.Grams("word", 1, 2), tm.Grams("char", 3, 4), tm.Cues())
    recipe = tm.TextRecipe("t", blocks, tm.Linear(loss, even=(even,), rounds=15))
    data = turns(spark)
    model = tm.fit_text_model(data, recipe)
    scored = {r["id"]: (r["label"], r["score"]) for r in model.scores(data).collect()}
    hits = np.mean([(s > 0) == (y == 1) for y, s in scored.values()])
    assert hits > 0.9
    model.save(str(tmp_path / "m"))
    again = tm.TextModel.load(str(tmp_path / "m"))
    assert again.features.recipe == recipe
    for r in again.scores(data).collect():
        assert r["score"] == pytest.approx(scored[r["id"]][1])
    profile = tm.vector_profile(model.features.transform(data.drop("label")), "features")
    assert profile.count() == len(scored)


def test_cross_validate_and_stack(spark):
    data = turns(spark)
    a = tm.TextRecipe("a", (tm.Grams("word", 1, 1),), tm.Linear("logistic", rounds=10))
    b = tm.TextRecipe("b", (tm.Cues(),), tm.Linear("logistic", rounds=10))
    board, oof = sw.config_sweep(data, [a, b], 3, 7)
    rows = board.collect()
    assert {r["name"] for r in rows} == {"a", "b"} and rows[0]["place"] == 1
    assert all(len(r["fold_scores_default"]) == 3 for r in rows)
    assert oof.groupBy("model", "id").count().where("count <> 1").count() == 0
    assert oof.count() == 2 * data.count()
    _, stacked = tm.stack_oof(oof, ["a", "b"])
    assert stacked.count() == data.count()
    wide = oof.groupBy("id", "label").pivot("model", ["a", "b"]).agg(F.first("score"))
    rows = wide.join(stacked.select("id", "fold", "score"), "id").toPandas()
    for fold in (0, 4):
        inside = rows["fold"] == fold
        alone, _ = tm.stack_oof(oof.join(stacked.where(f"fold <> {fold}").select("id"), "id"), ["a", "b"])
        value = rows.loc[inside, ["a", "b"]].to_numpy() @ alone.coefficients.toArray() + alone.intercept
        assert np.allclose(1 / (1 + np.exp(-value)), rows.loc[inside, "score"], atol=1e-6)
    _, labels = sw.fit_full_and_predict(data, data.select("id", "text"), b, 0.2)
    assert labels.where("tuned_label > default_label").count() == 0


def test_a_feature_block_is_required(spark):
    none = tm.TextRecipe("n", ())
    with pytest.raises(ValueError):
        tm.fit_features(turns(spark), none)


def test_the_vocabulary_is_a_table(spark):
    """Terms stay in rows that the n-grams are joined with; rows of equal ids and null texts keep vectors of their own."""
    data = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, None), (3, "aa cc cc")], "id long, text string")
    fitted = tm.fit_features(data, tm.TextRecipe("t", (tm.Grams("word", 1, 1),)))
    vocabulary = fitted.blocks["word"]
    idf = math.log(5 / 3) + 1
    assert sorted((r["term"], r["place"], round(r["idf"], 9)) for r in vocabulary.rows.collect()) == [
        (t, i, round(idf, 9)) for i, t in enumerate(("aa", "bb", "cc"))
    ]
    two = 1 + math.log(2)
    want = [(1, [two, 1, 0]), (1, [0, 1, 1]), (2, [0, 0, 0]), (3, [1, 0, two])]
    got = sorted((r["id"], *r["features"].toArray().round(6)) for r in fitted.transform(data).collect())
    assert got == sorted((i, *np.round(np.array(w) / (np.linalg.norm(w) or 1), 6), 1.0) for i, w in want)


@pytest.mark.parametrize("loss,even,most", [("logistic", ("copies",), None), ("hinge", ("weights",), 9)])
def test_folds_share_one_pass_over_the_texts(spark, monkeypatch, loss, even, most):
    """Scores are those of a fit on each fold's training rows by itself; ids repeat and a text is null."""
    blocks = (tm.Grams("word", 1, 2, most=most), tm.Grams("char", 3, 4), tm.Cues())
    recipe = tm.TextRecipe("t", blocks, tm.Linear(loss, even=even, rounds=6))
    more = spark.createDataFrame([(1, "um well I said that", 0), (500, None, 1), (500, "thanks for the help.", 1)], "id long, text string, label int")
    data, calls, cut = turns(spark).unionByName(more), [], tm.tf.term_counts

    def counted(texts, *args):
        calls.append(texts.count())
        return cut(texts, *args)

    monkeypatch.setattr(tm.tf, "term_counts", counted)
    oof = sw.cross_validate(data, recipe, 2, 7)
    assert calls == [data.count()] * 2
    got = sorted((r["fold"], r["id"], r["label"], r["score"]) for r in oof.collect())
    placed = stratified_kfold(data, 2, 7).localCheckpoint()
    want = []
    for fold in range(2):
        train = placed.where(F.col("fold") != fold).drop("fold")
        scored = tm.fit_text_model(train, recipe, 7 + fold + 1).scores(placed.where(F.col("fold") == fold))
        want += [(r["fold"], r["id"], r["label"], r["score"]) for r in scored.collect()]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and len(got) == data.count()
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=1e-6)
    assert max(calls) == data.count()


def test_a_fold_without_frequent_terms_is_refused(spark):
    rows = [(i, f"w{i // 2}", i % 2) for i in range(8)]
    data = spark.createDataFrame(rows, "id long, text string, label int")
    recipe = tm.TextRecipe("t", (tm.Grams("word", 1, 1, min_rows=5),))
    with pytest.raises(ValueError):
        sw.cross_validate(data, recipe, 2, 1)


def test_fits_side_by_side_fit_the_driver():
    """Five solvers with the arrays of a large vocabulary each once filled the driver."""
    def rows(terms):
        return tm.FoldRows(None, None, [(0, terms)]).side_by_side()

    assert rows(1000) == tm.PARALLEL_FITS and rows(400_000) == 2 and rows(5_000_000) == 1
    assert tm.FoldRows(None, None, []).side_by_side() == tm.PARALLEL_FITS
