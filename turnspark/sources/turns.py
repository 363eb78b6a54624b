"""Turn tables: labelled or unlabelled short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspark.ranking import position_rows

# Accepted names of the text column, first match wins.
TEXT_COLUMNS = ("text", "content", "utterance", "sentence")

TURN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def read_turns(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read the first location that exists; Parquet by suffix, otherwise CSV with a header.

    ``multi_line`` allows line breaks inside quoted CSV texts; each file is then read by one task.
    """
    for path in paths:
        try:
            if path.rstrip("/").endswith(".parquet"):
                return spark.read.parquet(path)
            reader = spark.read.option("header", True).option("multiLine", multi_line)
            reader = reader.option("escape", '"')
            return reader.schema(schema).csv(path) if schema else reader.csv(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"no turn table at any of {list(paths)}")


def standardize_turns(df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Give a table the columns id, text and (when present) an integer label.

    Without an id column the rows are numbered from 0 in the declared ``order``.
    """
    source = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if source is None:
        raise KeyError(f"no text column among {df.columns}")
    out = df.withColumn("text", F.coalesce(F.col(source).cast("string"), F.lit("")))
    if source != "text":
        out = out.drop(source)
    if "label" in out.columns:
        out = out.withColumn("label", F.col("label").cast("int"))
    if "id" not in out.columns:
        if not order:
            raise ValueError("a table without ids needs a declared row order")
        out = position_rows(out, list(order), "id")
    return out
