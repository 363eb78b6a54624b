"""The entry module from a foreign working folder, as a driver would use it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_module", {REPO + "/__spark_entry__.py"!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
assert set(module.oracle_sql()) <= set(module.queries())
print("rows", module.queries()["whitened_second_moment"](spark, {SF!r}).count())
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 160" in done.stdout, done.stderr[-2000:]
