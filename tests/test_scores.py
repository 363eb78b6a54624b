"""Metrics, thresholds, gates and ensembles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.operators import ensemble as en
from turnspark.operators import metrics as m
from turnspark.operators import thresholds as th


def brute_macro(y, pred):
    scores = []
    for c in sorted(set(y) | set(pred)):
        tp = sum(a == c and b == c for a, b in zip(y, pred))
        wrong = sum((a == c) != (b == c) for a, b in zip(y, pred))
        scores.append(2 * tp / (2 * tp + wrong))
    return float(np.mean(scores))


def scored(spark, y, s):
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, label int, score double").repartition(3)


def test_threshold_golden(spark):
    best = th.tune_threshold_probs(scored(spark, [0, 0, 1, 1], [0.31, 0.405, 0.61, 0.69])).first()
    assert best["threshold"] == pytest.approx(0.41) and best["macro_f1"] == 1.0


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 150)
    s = np.round(np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.15, 150), 0, 1), 2)
    grid = th.prob_grid()
    got = th.sweep(scored(spark, y, s), grid).orderBy("threshold").collect()
    assert [r["threshold"] for r in got] == grid.values()
    for r in got:
        assert r["macro_f1"] == pytest.approx(brute_macro(y, (s >= r["threshold"]).astype(int)))


def test_score_threshold_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    s = rng.normal(y, 1.0)
    df = scored(spark, y, s)
    grid = np.unique(np.append(np.linspace(*np.percentile(s, [1, 99]), 401), 0.0))
    f1 = [brute_macro(y, (s >= t).astype(int)) for t in grid]
    best = th.tune_threshold_scores(df).first()
    assert best["macro_f1"] == pytest.approx(max(f1))
    assert best["threshold"] == pytest.approx(grid[int(np.argmax(f1))], abs=1e-9)


def test_constant_scores(spark):
    best = th.tune_threshold_scores(scored(spark, [0, 1, 1], [2.0, 2.0, 2.0])).first()
    assert best["threshold"] == 0.0 and best["macro_f1"] == pytest.approx(0.4)


def test_macro_f1_golden(spark):
    df = scored(spark, [0, 0, 1, 1], [0, 0, 0, 0]).withColumn("pred", F.lit(1))
    assert m.macro_f1(df, (0, 1)).first()[0] == pytest.approx(1 / 3)
    one = scored(spark, [1, 1], [1, 1]).withColumn("pred", F.lit(1))
    assert m.macro_f1(one, (0, 1)).first()[0] == 1.0


def test_report_totals(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "label int, pred int")
    rows = {r["name"]: r for r in m.classification_report(df, (0, 1, 2)).collect()}
    assert rows["accuracy"]["f1"] == pytest.approx((y == p).mean())
    assert rows["weighted avg"]["recall"] == pytest.approx((y == p).mean())
    cells = m.confusion_matrix(df, (0, 1, 2, 3)).collect()
    assert len(cells) == 16 and sum(r["n"] for r in cells) == 60


def test_pseudo_counts_golden(spark):
    df = spark.createDataFrame([(p,) for p in (0.995, 0.97, 0.5, 0.015, 0.005)], "prob double")
    got = {r["cut"]: (r["positive"], r["negative"]) for r in m.pseudo_label_counts(df).collect()}
    assert got == {0.99: (1, 1), 0.98: (1, 2), 0.95: (2, 2)}


def test_confidence_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "prob double")
    row = m.confidence_summary(empty, 0.5).first()
    assert row["count"] == 0 and row["min_margin"] is None and row["max_prob"] is None


def pairs(spark):
    rows = [(0, 0, 0.9, 3, 0), (1, 1, 0.4, 3, 3), (2, 2, 0.6, 3, 2)]
    return spark.createDataFrame(
        rows, "id long, strong_label int, confidence double, diverse_label int, y int"
    )


@pytest.mark.parametrize("k,want", [(0, [0, 1, 2]), (1, [0, 3, 2]), (9, [3, 3, 3])])
def test_gate_golden(spark, k, want):
    got = en.confidence_gate(pairs(spark), k).orderBy("id").collect()
    assert [r["label"] for r in got] == want


def test_gate_sweep(spark):
    got = {r["k"]: r for r in en.gate_sweep(pairs(spark), [1, 2, 9]).collect()}
    assert got[1]["accuracy"] == 1.0 and got[1]["changed"] == 1
    assert got[2]["accuracy"] == pytest.approx(2 / 3) and got[9]["gated"] == 3


def test_ensemble_errors(spark):
    rows = [("a", 1, [0.2, 0.8]), ("b", 1, [0.6, 0.4]), ("a", 2, [1.0, 0.0])]
    probs = spark.createDataFrame(rows, "model string, id long, probs array<double>")
    with pytest.raises(Exception, match="not exactly one output"):
        en.ensemble_mean(probs, ["a", "b"], 2).collect()
    with pytest.raises(ValueError):
        en.ensemble_mean(probs, ["a", "b"], 2, [1.0])
    mean = en.ensemble_mean(probs.where("id = 1"), ["a", "b"], 2, [3, 1]).first()
    assert mean["probs"] == pytest.approx([0.3, 0.7]) and mean["label"] == 1


def test_specs_with_two_seeds(spark):
    members = spark.createDataFrame([(42, 0.9), (13, 0.95)], "seed int, score double")
    got = en.ensemble_specs(members).collect()
    assert [(r["name"], r["members"]) for r in got] == [("pair_average", [42, 13])]


def test_complement_moments(spark):
    rng = np.random.default_rng(2)
    s, f = rng.normal(1000.0, 1e-3, 90), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(f, s)], "fold int, score double")
    for r in en.complement_moments(df, "score", "fold").collect():
        rest = s[f != r["fold"]]
        assert r["n"] == len(rest) and r["mu"] == pytest.approx(rest.mean())
        assert r["var"] == pytest.approx(rest.var(), rel=1e-4)


def test_best_epoch_and_candidate(spark):
    h = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, val double")
    assert en.best_epoch(h, "val").first()["epoch"] == 2
    c = spark.createDataFrame(
        [("a", 0.5, 0), ("b", None, 1), ("c", 0.9, 2)], "name string, s double, pos int"
    )
    assert en.best_candidate(c, "b", "s").first()["name"] == "b"
    assert en.best_candidate(c, "none", "s").first()["name"] == "c"
