"""Every query with an SQL twin agrees with DuckDB on the smallest tables."""

import os

import pytest

import oracle_check
from turnspark.queries import REGISTRY, SQL, load_all

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF)


def test_registry():
    assert set(SQL) <= set(REGISTRY)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    result, _ = oracle_check.check(spark, duck, SF, name)
    assert result.startswith("ok"), result
