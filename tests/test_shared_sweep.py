"""Models that share one pass: the solver against numpy, shared counts against per-fold ones, batched thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.functions.text import char_wb_ngrams
from turnspark.models import sparse_linear as sl
from turnspark.operators import thresholds as th
from turnspark.operators.balance import random_oversample
from turnspark.plans import shared_sweep as ss
from turnspark.queries import experiments
from turnspark.shipping import ship_package

GOOD = ["thanks a lot for the help", "the train leaves at nine", "please open the window now", "we had dinner at home"]
BAD = ["so I was going to", "and then because of the", "um well I think that", "could you maybe get me a"]


def turns(spark, n=8):
    rows = []
    for i in range(n):
        rows += [(f"{t} {'x' * (i % 3)}".strip() + ".", 1) for t in GOOD]
        rows += [(f"{t} {'uh' * (i % 2)}".strip(), 0) for t in BAD[: 2 + i % 3]]
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "id long, text string, label int")


def dense(rng, n, width, views):
    x = np.where(rng.random((n, width)) < 0.2, rng.random((n, width)) + 0.5, 0.0)
    factor = np.where(rng.random((width, views)) < 0.8, rng.random((width, views)) + 0.5, 0.0)
    return x, factor


def test_gradient_vanishes_at_the_weights(spark):
    """Two blocks, several views, losses, costs and row choices; the objective's gradient by dense numpy."""
    ship_package(spark)
    rng = np.random.default_rng(4)
    n = 60
    x, factor = dense(rng, n, 30, 2)
    z, other = dense(rng, n, 7, 3)
    label = (rng.random(n) < 0.4).astype(int)
    times = np.stack([np.ones(n), rng.integers(0, 3, n)], axis=1).astype(float)
    rows = []
    for i in range(n):
        at = [int(j) for j in np.nonzero(x[i])[0]] + [30 + int(j) for j in np.nonzero(z[i])[0]]
        rows.append((i, int(label[i]), times[i].tolist(), at, [float(v) for v in [*x[i][x[i] > 0], *z[i][z[i] > 0]]]))
    blocks = sl.Blocks({"a": (0, 30), "b": (30, 37)}, {"a": factor, "b": other})
    df = spark.createDataFrame(rows, "id long, label int, weights array<double>, idx array<int>, val array<double>").repartition(3)
    df = sl.with_scales(df, blocks, unscaled=("b",)).cache()
    fits = [
        sl.Fit("p", 0, {"a": 0}, "hinge", 0.5, 0), sl.Fit("q", 0, {"a": 1, "b": 2}, "hinge", 2.0, 1, (0.7, 1.9)),
        sl.Fit("r", 1, {"b": 0}, "logistic", 1.0, 1), sl.Fit("s", 1, {"a": 0, "b": 1}, "logistic", 3.0, 0, (2.0, 0.5)),
    ]
    fitted = sl.fit_many(df, blocks, fits, 1e-7)
    scores = {r["id"]: r["scores"] for r in fitted.scores(df, ["id"]).collect()}
    sign = np.where(label == 1, 1.0, -1.0)
    for k, f in enumerate(fits):
        parts, weights = [], []
        for b, whole in (("a", x), ("b", z)):
            if b in f.views:
                seen = whole * blocks.factors[b][:, f.views[b]]
                length = np.sqrt((seen**2).sum(axis=1, keepdims=True))
                parts.append(seen / np.where(length > 0, length, 1) if b == "a" else seen)
                weights.append(fitted.weights.parts[b][:, list(fitted.weights.owners[b]).index(k)])
        data, w = np.hstack(parts), np.concatenate(weights)
        margin = data @ w
        share = f.trust * times[:, f.rows] * np.array(f.classes)[label]
        slope = -2 * np.maximum(0, 1 - sign * margin) if f.loss == "hinge" else -1 / (1 + np.exp(sign * margin))
        left = w + data.T @ (share * slope * sign)
        assert np.linalg.norm(left) < 1e-5
        assert np.allclose([scores[i][k] for i in range(n)], margin)


def test_unreached_tolerance_is_an_error():
    def bowl(stack):
        part = stack.parts["a"]
        return ((part - 3) ** 4).sum(axis=0), sl.Stack({"a": 4 * (part - 3) ** 3}, stack.owners, 1)

    start = sl.Stack({"a": np.zeros((2, 1))}, {"a": np.array([0])}, 1)
    with pytest.raises(RuntimeError):
        sl.minimise(bowl, start, 1e-12, 5)


def test_copies_are_those_of_each_folds_oversampling(spark):
    data = turns(spark)
    members = {r["id"]: r for r in ss.memberships(data, 3, 9).collect()}
    placed = spark.createDataFrame([(i, r["label"], r["fold"]) for i, r in members.items()], "id long, label int, fold int")
    for f in range(3):
        train = placed.where(F.col("fold") != f).select("id", "label")
        want = {r["id"]: r["n"] for r in random_oversample(train, 9 + f + 1).groupBy("id").agg(F.count("*").alias("n")).collect()}
        assert {i: int(r["weights"][4 + f]) for i, r in members.items() if r["weights"][4 + f]} == want
        assert all((r["weights"][f] == 1) == (r["fold"] != f) for r in members.values())


def test_spans_of_the_shared_counts(spark):
    """Terms of any character span are a part of the shared ones."""
    df = spark.createDataFrame([(1, "a bb ccc dddd eeeeeee é"), (2, "a bb xx ccc")], "id long, text string")
    wide = {r["term"] for r in ss.gram_counts(df).where("unit = 'char'").collect()}
    size = {t: -len(t) if t.startswith(" ") and t.endswith(" ") else len(t) for t in wide}
    for low, high in ((3, 5), (4, 6), (3, 6)):
        want = {t for r in df.select(char_wb_ngrams(F.col("text"), low, high).alias("g")).collect() for t in r["g"]}
        got = {t for t in wide if ss.in_span(np.array([size[t]]), (low, high))[0]}
        assert got == want


def test_thresholds_of_many_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(round(s, 3)), int(rng.random() < 0.5 + 0.3 * np.sign(s))) for k in "abc" for s in rng.normal(size=120 if k != "c" else 3)]
    rows += [("flat", 0.5, i % 2) for i in range(5)]
    df = spark.createDataFrame(rows, "name string, score double, label int")
    got = {r["name"]: r for r in th.tune_thresholds_by(df, "name").collect()}
    for k in ("a", "b", "c", "flat"):
        want = th.tune_threshold_scores(df.where(F.col("name") == k)).first()
        assert (got[k]["threshold"], got[k]["macro_f1"], got[k]["tp"]) == (want["threshold"], want["macro_f1"], want["tp"])


def test_sweep_and_bagging(spark):
    ship_package(spark)
    data = turns(spark)
    single = (ss.Config("w", (1, 2)), ss.Config("c", char=(4, 6), copies=True))
    board, scores, fitted = ss.shared_sweep(data, 3, 5, single, (ss.Config("u", (1, 3), (3, 6), True, "logistic", 2.0, True),))
    rows = {r["name"]: r for r in board.collect()}
    assert len(rows) == 6 and {r["kind"] for r in rows.values()} == {"word", "char", "word+char+cues", "ensemble"}
    places = sorted(rows.values(), key=lambda r: r["place"])
    assert all(a["mean_score"] >= b["mean_score"] for a, b in zip(places, places[1:]))
    assert fitted.left.max() <= ss.SWEEP_TOLERANCE
    assert scores.groupBy("model", "id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "valid").alias("v")).where("n <> 3 or v <> 1").count() == 0
    other = spark.createDataFrame([(900 + i, t) for i, t in enumerate([*GOOD, *BAD, ""])], "id long, text string")
    found, own = ss.bagged_predict(data, other, ss.Config("b", cues=True, loss="logistic", weights=True), 3, 5)
    cut = th.tune_threshold_probs(own).first()["threshold"]
    for r in found.collect():
        assert r["prob"] == pytest.approx(np.mean(r["members"]), abs=1e-6) and r["pred"] == int(r["prob"] >= cut)
    assert found.count() == 9 and own.count() == data.count()


def test_registered_sweep_has_every_configuration(spark, monkeypatch):
    """Word, character, union and cue configurations alike go into the sweep, and so the ensembles."""
    seen = []

    def sweep(turns, folds, seed, single=ss.SINGLE, union=ss.UNION):
        seen.extend(c.name for c in (*single, *union))
        board = spark.createDataFrame([(1, "n", "word", 0.5, 0.1, 0.0, 0.5, [0.5])], "place int, name string, kind string, mean_score double, std_score double, threshold double, tuned_macro_f1 double, fold_scores array<double>")
        return board, None, None

    monkeypatch.setattr(experiments.v, "turns", lambda *_: None)
    monkeypatch.setattr(ss, "shared_sweep", sweep)
    assert experiments.sweep_query(spark, "").count() == 1
    assert seen == [c.name for c in (*ss.SINGLE, *ss.UNION)] and len(seen) == 19
