"""Inputs that once gave wrong results or never ended."""

import pytest

from turnspark.operators import balance as bl
from turnspark.operators import duplicates as du
from turnspark.operators import near as nr
from turnspark.ranking import exact_quantiles
from turnspark.sources import labels as lb


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_quantiles_refuse_values_that_are_not_finite(spark, bad):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, bad)], "v double")
    with pytest.raises(ValueError, match="not finite"):
        exact_quantiles(df, "v", [0.5])


@pytest.mark.parametrize("values", [[0.0, 5e-324, 1e-323, 1.5e-323], [-1.7e308, -1.0, 1.0, 1.7e308]])
def test_quantiles_of_extreme_spans(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert exact_quantiles(df, "v", [0.0, 1 / 3, 1.0]) == [values[0], values[1], values[3]]


def test_oversample_text_ids(spark):
    rows = [(f"row {i}", int(i < 2)) for i in range(8)]
    out = bl.random_oversample(spark.createDataFrame(rows, "id string, label int"), 42)
    assert sorted(r["label"] for r in out.collect()) == [0] * 6 + [1] * 6


def test_near_matches_keep_their_schema_without_hits(spark):
    train = spark.createDataFrame([("a", 0, "one two three", 1)], "id string, pos long, text string, label int")
    test = spark.createDataFrame([("b", 0, "nothing alike here")], "id string, pos long, text string")
    none = nr.near_matches(train, test)
    assert none.count() == 0 and dict(none.dtypes)["test_id"] == dict(none.dtypes)["train_id"] == "string"


def test_overrides_of_equal_strength(spark):
    base = spark.createDataFrame([(1, 0)], "id long, label int")
    rows = [(1, 3, "exact"), (1, 5, "exact"), (1, 4, "exact")]
    overrides = spark.createDataFrame(rows, "id long, new_label int, match_type string").repartition(3)
    assert du.apply_overrides(base, overrides).first()["label"] == 5


def test_labels_written_as_one_file_pass_the_audit(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS pos", "id", "cast(id % 2 AS int) AS label").repartition(4)
    lb.write_labels(df, str(tmp_path / "out"), single_file=True)
    audit = lb.audit_labels(spark, str(tmp_path / "out"), df.select("pos", "id"), [0, 1]).collect()
    assert [r["status"] for r in audit] == ["OK"]
