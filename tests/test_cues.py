"""The cue stage in pipelines."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from turnspark.functions.text import ENDPOINT_NAMES, endpoint_features
from turnspark.models.cues import CueTransformer


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "Could you, um, help me?", 1.0, 5), (1, None, 0.0, 6), (2, "", 0.0, 7), (3, "I went and then", 0.0, 8)]
    return spark.createDataFrame(data, "id long, said string, label double, log_chars int")


def test_reloaded_pipeline_equals_the_columns(spark, rows, tmp_path):
    path = str(tmp_path / "pipeline")
    stages = [CueTransformer(inputCol="said", outputCol="x"), LogisticRegression(featuresCol="x")]
    fitted = Pipeline(stages=stages).fit(rows)
    fitted.write().save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].getInputCol() == "said" and again.stages[0].getOutputCol() == "x"
    got = again.transform(rows).select("id", vector_to_array("x").alias("x"), "prediction", "log_chars").orderBy("id").collect()
    want = rows.select("id", F.array(*endpoint_features(F.col("said"))).alias("x")).orderBy("id").collect()
    assert [list(r["x"]) for r in got] == [list(r["x"]) for r in want]
    assert [r["log_chars"] for r in got] == [5, 6, 7, 8] and len(got[0]["x"]) == len(ENDPOINT_NAMES)
    assert [r["prediction"] for r in got] == [r["prediction"] for r in fitted.transform(rows).orderBy("id").collect()]


def test_columns_are_checked(rows):
    with pytest.raises(ValueError, match="no column"):
        CueTransformer(inputCol="text").transform(rows)
    with pytest.raises(ValueError, match="already"):
        CueTransformer(inputCol="said", outputCol="label").transform(rows)
    assert CueTransformer(inputCol="said").transform(rows.limit(0)).count() == 0
