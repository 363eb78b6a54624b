"""Splits, ranks, balance and skew-safe joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.operators import balance, splits
from turnspark.ranking import exact_quantiles, hash_rank, position_rows, seeded_hash
from turnspark.skew import lookup_join


def labelled(spark, n=200, parts=5):
    rows = [(i, int(i % 5 != 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int").repartition(parts)


def test_kfold_partitions_every_label(spark):
    out = splits.stratified_kfold(labelled(spark, 203), 5, 7).collect()
    assert sorted(r["id"] for r in out) == list(range(203))
    for label in (0, 1):
        sizes = np.bincount([r["fold"] for r in out if r["label"] == label], minlength=5)
        assert sizes.max() - sizes.min() <= 1


def test_splits_do_not_depend_on_partitions(spark):
    def folds(parts):
        df = splits.stratified_kfold(labelled(spark, 100, parts), 4, 3)
        return {r["id"]: r["fold"] for r in df.collect()}

    assert folds(1) == folds(8)


def test_kfold_golden(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, label int")
    out = splits.stratified_kfold(rows, 5, 1).groupBy("fold", "label").count().collect()
    assert len(out) == 10 and all(r["count"] == 1 for r in out)


def test_holdouts(spark):
    df = labelled(spark)
    out = splits.stratified_holdout(df, 0.2, 1)
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {(0, "valid"): 8, (0, "train"): 32, (1, "valid"): 32, (1, "train"): 128}
    tiny = spark.createDataFrame([(1,), (2,)], "id long")
    sides = [r["split"] for r in splits.random_holdout(tiny, 0.99, 1).collect()]
    assert sorted(sides) == ["train", "valid"]


def test_subset_quota(spark):
    out = splits.stratified_subset(labelled(spark), 33, 1)
    assert out.count() == 33
    assert splits.stratified_subset(labelled(spark), 500, 1).count() == 200
    assert splits.quotas({0: 1, 1: 1, 2: 1}, 2) == {0: 1, 1: 1, 2: 0}


def test_hash_rank_equals_plain_window(spark):
    df = labelled(spark, 500)
    digest = seeded_hash(9, F.col("id"))
    ranked = hash_rank(df, digest, F.col("id"), ["label"]).collect()
    for label in (0, 1):
        import hashlib

        ids = [r["id"] for r in ranked if r["label"] == label]
        order = sorted(ids, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        assert {r["id"]: r["rank"] for r in ranked if r["label"] == label} == {
            i: n + 1 for n, i in enumerate(order)
        }


def test_hash_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    out = hash_rank(df, seeded_hash(1, F.col("id")), F.col("id"), ["g"]).collect()
    assert sorted(r["rank"] for r in out) == [1, 1, 2]


def test_position_rows(spark):
    values = random.Random(4).sample(range(10_000), 300)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r["v"]: r["pos"] for r in position_rows(df, [F.col("v")]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


@pytest.mark.parametrize(
    "values",
    [
        [float(i) for i in range(101)],
        [1.0] * 50 + [2.0],
        [3.5],
        list(np.random.default_rng(1).normal(size=777)),
        [0.0, 1e-300, 1e300, -1e300] * 5,
    ],
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    got = exact_quantiles(df, "v", [0.01, 0.5, 0.99])
    assert got == pytest.approx(np.percentile(values, [1, 50, 99]).tolist(), rel=1e-12)


def test_lookup_join_with_hot_key(spark):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "id long, k string"
    )
    lookup = rows.select("k").distinct().where("k <> 'k0'").withColumn("v", F.length("k"))
    got = lookup_join(rows, lookup, ["k"], ["id"])
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(900) if i != 0]
    left = lookup_join(rows, lookup, ["k"], ["id"], "left")
    assert left.count() == 900 and left.where("v is null").count() == 1


def test_oversample_is_exact(spark):
    df = labelled(spark)
    out = balance.random_oversample(df, 5).collect()
    assert sum(r["label"] == 0 for r in out) == sum(r["label"] == 1 for r in out) == 160
    kept = [r["id"] for r in out if r["draw_id"] is None]
    assert sorted(kept) == [r["id"] for r in df.where("label = 1").orderBy("id").collect()]
    assert {r["id"] for r in out if r["label"] == 0} <= {i for i in range(200) if i % 5 == 0}
    again = balance.random_oversample(df.repartition(2), 5).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    golden = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, label int")
    assert balance.random_oversample(golden, 1).groupBy("label").count().orderBy("label").collect() == [
        (0, 3),
        (1, 3),
    ]


def test_weights_golden(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, label int")
    got = {r["id"]: r["weight"] for r in balance.balanced_weights(df).collect()}
    assert got == pytest.approx({1: 4 / 6, 2: 4 / 6, 3: 4 / 6, 4: 2.0})


def test_mixup(spark):
    rows = [(i, i % 3, [float(i), float(-i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    out = balance.mixup(df, 16, 0.4, 3).collect()
    assert sorted(r["id"] for r in out) == sorted(r["partner_id"] for r in out) == list(range(50))
    for r in out:
        value = r["lam"] * r["id"] + (1 - r["lam"]) * r["partner_id"]
        assert r["x"] == pytest.approx([value, -value])
        assert r["y_a"] == r["id"] % 3 and r["y_b"] == r["partner_id"] % 3
    assert len({(r["batch"], r["lam"]) for r in out}) == 4
    still = balance.mixup(df, 16, 0.0, 3).collect()
    assert all(r["x"] == [r["id"], -r["id"]] for r in still)
