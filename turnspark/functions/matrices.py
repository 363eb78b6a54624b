"""Arrow batches as numpy blocks, and sums of per-batch statistics.

Spark partitions and shuffles the rows; numpy only sees one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Block = dict[str, np.ndarray]


def _is_list(kind: pa.DataType) -> bool:
    return pa.types.is_list(kind) or pa.types.is_large_list(kind)


def _column(values: pa.Array) -> np.ndarray:
    """A flat list column as an (N, L) block, any other column as N values."""
    if not _is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)


def _uniform_parts(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Split a batch so that every list column has one length per part."""
    if batch.num_rows == 0:
        return
    lengths = [
        batch.column(n).value_lengths().to_numpy(zero_copy_only=False)
        for n in names
        if _is_list(batch.column(n).type)
    ]
    if not lengths or all((x == x[0]).all() for x in lengths):
        yield batch
        return
    shapes = np.stack(lengths, axis=1)
    for shape in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == shape).all(axis=1))
        yield batch.take(pa.array(rows))


def _to_arrow(values: np.ndarray) -> pa.Array:
    values = np.asarray(values)
    if values.ndim == 1:
        return pa.array(values)
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(
        n + 1, dtype=np.int32
    )
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def block_stage(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Mapping[str, str],
    fn: Callable[[Block], Block],
    keep: Sequence[str],
    repeat: bool = False,
) -> DataFrame:
    """Map row blocks with numpy.

    ``fn`` gets the input columns (flat arrays as N x L blocks) and returns the output
    columns. With ``repeat`` it also returns ``_row``, the input row of every output row.
    """
    used = list(dict.fromkeys([*keep, *inputs]))
    fields = [df.schema[k] for k in keep]
    fields += [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]
    schema = T.StructType(fields)
    arrow_types = {n: t for n, t in zip(outputs, _arrow_types(outputs))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _uniform_parts(whole, inputs):
                block = {n: _column(batch.column(n)) for n in inputs}
                out = fn(block)
                base = batch.take(pa.array(out.pop("_row"))) if repeat else batch
                columns = [base.column(k) for k in keep]
                columns += [_to_arrow(out[n]).cast(arrow_types[n]) for n in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    return df.select(*used).mapInArrow(run, schema)


def _arrow_types(outputs: Mapping[str, str]) -> list[pa.DataType]:
    simple = {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "double": pa.float64(),
        "array<double>": pa.list_(pa.float64()),
    }
    return [simple[t] for t in outputs.values()]


def summed_blocks(
    df: DataFrame, inputs: Sequence[str], fn: Callable[[Block], dict[tuple, np.ndarray]]
) -> dict[tuple, np.ndarray]:
    """Add up keyed statistics that ``fn`` computes per batch.

    Each task adds its own batches and emits one row per key; the final sum combines
    map-side again. Keys come from a closed domain (classes, folds).
    """
    schema = "key string, total array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in _uniform_parts(whole, inputs):
                block = {n: _column(batch.column(n)) for n in inputs}
                for key, part in fn(block).items():
                    name = "|".join(str(k) for k in key)
                    flat = np.asarray(part, dtype=float).reshape(-1)
                    totals[name] = totals[name] + flat if name in totals else flat
        if totals:
            rows = pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), rows], ["key", "total"])

    parts = df.select(*dict.fromkeys(inputs)).mapInArrow(run, schema)
    sums = parts.groupBy("key").agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    )
    return {tuple(r["key"].split("|")): np.array(r["total"]) for r in sums.collect()}


def mean_arrays(df: DataFrame, by: Sequence[str], column: str, name: str = "mean") -> DataFrame:
    """Element-wise mean of a flat array column per group; combines map-side in the JVM."""
    return df.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(column)))).alias(name),
        F.count(F.lit(1)).alias("n"),
    )


def square(block: np.ndarray) -> np.ndarray:
    """(N, C*C) -> (N, C, C)."""
    size = int(round(block.shape[1] ** 0.5))
    return block.reshape(len(block), size, size)


def flat(block: np.ndarray) -> np.ndarray:
    return block.reshape(len(block), -1)


def spectral(matrices: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Apply ``fn`` to the eigenvalues of symmetric matrices (..., C, C)."""
    values, vectors = np.linalg.eigh(matrices)
    return (vectors * fn(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)
