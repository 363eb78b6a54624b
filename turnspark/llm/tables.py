"""Shared tables, row keys and byte words for the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnspark.lineage import ensure_checkpoint_dir
from turnspark.shipping import ship_package

SLICE_ROWS = 256

#: How to drop what each operator remembers in this worker from task to task.
_KEPT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder as Parquet and go on from the files.

    Columnar files are a good deal smaller than a checkpointed RDD; lost executors cost a re-read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps that nothing refers to any more.

    It goes by the driver's garbage collections, which are rare while the driver has little to do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def from_files(df: DataFrame) -> DataFrame:
    """The rows as a plain scan of files, stored first if they are anything else.

    Operators that key the same rows twice do this first, so that both get the same keys.
    """
    plan = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return df if plan == "LogicalRelation" else stored(df, "rows")


def keyed(df: DataFrame) -> DataFrame:
    """``row`` (all columns) with ``file`` and ``place``, which name a row of stored files.

    Repeated rows and repeated ids get keys of their own. Anything but a plain file scan is
    stored first, as only file positions are stable under retries.
    """
    df = from_files(df)
    meta = df.metadataColumn("_metadata")
    return df.select(
        F.xxhash64(meta["file_path"]).alias("file"),
        meta["row_index"].alias("place"),
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"),
    )


def utf8(text: Column) -> Column:
    """The text's bytes; null stays null."""
    return text.cast("string").cast("binary")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into small ones, so that only a few whole texts are Python objects at a time.

    At the end the worker returns its free memory, as Spark keeps it for later tasks of other kinds.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    batch = None
    return_free_memory()


def remember(operator: str, drop: Callable[[], None] | None = None) -> None:
    """Name the operator that goes on in this worker; what others remember here is dropped.

    Spark hands workers on from stage to stage, and without this each would hold the memory of all stages.
    """
    others = [name for name in _KEPT if name != operator]
    for name in others:
        _KEPT.pop(name)()
    if others:
        gc.collect()
        return_free_memory()
    if drop is not None:
        _KEPT[operator] = drop


def return_free_memory() -> None:
    """Give freed blocks of Arrow and of the C library back to the system, where these can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
