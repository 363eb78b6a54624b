"""Texts whose fixed score rounds to a probability of 1, as long ones do in larger tables."""

import math

import numpy as np
import pytest

from turnspark.operators import thresholds as th
from turnspark.queries import REGISTRY, load_all

load_all()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents 0..599, the first two certain; the even ones have labels."""
    path = str(tmp_path_factory.mktemp("certain"))
    docs = [(i, "and so " * (900 if i < 2 else i % 7) + f"row {i}.") for i in range(600)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 600, 2)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_binary_score(spark, folder):
    rows = {r["id"]: r for r in REGISTRY["binary_score"](spark, folder).collect()}
    assert len(rows) == 300
    assert rows[0]["class1"] == 1.0 and rows[0]["decision"] == math.inf
    assert all(math.isfinite(r["decision"]) for i, r in rows.items() if i > 0)


def test_labels_from_scores(spark, folder):
    rows = REGISTRY["labels_from_scores"](spark, folder).collect()
    assert len(rows) == 300
    assert all(r["above_zero"] == int(r["prob"] > 0.5) for r in rows)


def test_pseudo_label_counts(spark, folder):
    rows = REGISTRY["pseudo_label_counts"](spark, folder).collect()
    assert len(rows) == 3 and all(r["positive"] >= 1 for r in rows)


def test_score_grid_counts_infinite_scores(spark):
    values = [float(i) for i in range(400)] + [math.inf] * 3 + [-math.inf] * 2
    df = spark.createDataFrame([(x, int(x > 200)) for x in values], "score double, label int")
    grid = th.threshold_grid(df, "score")
    ordered = sorted(values)
    low, high = (np.interp(p * 404, range(405), np.nan_to_num(ordered, posinf=1e9, neginf=-1e9)) for p in (0.01, 0.99))
    assert grid.low == pytest.approx(low) and grid.values()[-1] == pytest.approx(high)
    best = th.tune_threshold_scores(df).first()
    assert (best["tp"], best["fp"], best["fn"], best["tn"]) == (202, 0, 0, 203)
    with pytest.raises(ValueError, match="not finite"):
        th.threshold_grid(df.where("score > 350"), "score")


@pytest.mark.parametrize("name, rows", [("threshold_grid", 402), ("tune_threshold_scores", 1)])
def test_tuning_queries(spark, folder, name, rows):
    got = REGISTRY[name](spark, folder).collect()
    assert len(got) == rows and all(math.isfinite(r["threshold"]) for r in got)
