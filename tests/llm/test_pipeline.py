"""The stages one after another against the single operators."""

import os

import pytest

import corpus_pipeline
from turnspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == kept.count() < docs.count()
