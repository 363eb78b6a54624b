"""Vectors as one byte a part: integer codebooks, with distances read from dictionaries of the values of each dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import remember, return_free_memory, stored
from turnspark.skew import lookup_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256  # steps of a unit
FARTHEST = 1 << 29  # integers beyond it count as it, so that distances fit in 64 bits
GATHER_ROWS = 1024  # rows whose distances to all entries are held at once


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: ``entries[p]`` has a row of integers for each entry of part p.

    Part p covers the dimensions ``bounds[p]`` to ``bounds[p + 1]``.
    """

    bounds: tuple[int, ...]
    entries: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.bounds[-1]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, comma-joined."""
        numbers = (str(x) for part in self.entries for x in part.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for: the middle of each component's step."""
        return np.concatenate([e[c] for e, c in zip(self.entries, code)] + [np.zeros(0)]) / SCALE + 0.5 / SCALE


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~odd)


def whole_numbers(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Row by row floor(SCALE * x), up to FARTHEST."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -FARTHEST, FARTHEST).astype(np.int64).reshape(len(vectors), width)


def nearest(values: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry (rows x parts) and squared distance of every part; the lower of equally near entries.

    Each dimension's distinct integers form a dictionary and are met with all entries once. A
    part's distances are then sums of rows of these tables, taken by dictionary code.
    """
    tables = []
    for part, (low, high) in enumerate(zip(books.bounds, books.bounds[1:])):
        for at in range(low, high):
            words, code = np.unique(values[:, at], return_inverse=True)
            tables.append((part, (words[:, None] - books.entries[part][:, at - low]) ** 2, code))
    chosen = np.zeros((len(values), len(books.entries)), dtype=np.uint8)
    far = np.zeros(chosen.shape, dtype=np.int64)
    for start in range(0, len(values), GATHER_ROWS):
        rows = slice(start, start + GATHER_ROWS)
        sums: list[np.ndarray | None] = [None] * len(books.entries)
        for part, table, code in tables:
            taken = table[code[rows]]
            sums[part] = taken if sums[part] is None else np.add(sums[part], taken, out=sums[part])
        for part, total in enumerate(sums):
            if total is not None:
                chosen[rows, part] = total.argmin(axis=1)
                far[rows, part] = total.min(axis=1)
    return chosen, far


def _sums(books: Codebooks):
    """Per task: rows and sum of each dimension's integers by entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("vector_codes")
        size = len(books.entries[0])
        total = np.zeros((books.width, size), dtype=np.int64)
        count = np.zeros((len(books.entries), size), dtype=np.int64)
        for batch in batches:
            values = whole_numbers(batch.column("embedding"), books.width)
            chosen, _ = nearest(values, books)
            for part, (low, high) in enumerate(zip(books.bounds, books.bounds[1:])):
                count[part] += np.bincount(chosen[:, part], minlength=size)
                for at in range(low, high):
                    # a batch's sums stay below 2^53, where doubles are exact
                    total[at] += np.bincount(chosen[:, part], values[:, at], minlength=size).astype(np.int64)
        of = np.repeat(np.arange(len(books.entries)), np.diff(books.bounds))
        at, entry = np.nonzero(count[of])
        arrays = [pa.array(x) for x in (at.astype(np.int32), entry.astype(np.int32), total[at, entry], count[of[at], entry])]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "entry", "total", "n"])
        return_free_memory()

    return run


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vec_id`` and ``embedding``; None if no vector is left.

    Vectors are cut into equal consecutive parts, as equal as can be where the width does not divide.
    A part's first entries are that part of the vectors with the smallest vec_id (null last, equal ids by
    vector). Each round assigns all vectors and moves every entry to the floor of the mean of its parts; an
    entry without parts stays. The driver holds ``entries`` vectors and as many sums, nothing that grows.
    The width is that of the first vector; vectors of another width have no code.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    kept = finite(vectors.select("vec_id", "embedding"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0]["embedding"])
    kept = kept.where(F.size("embedding") == width)
    seeds = [r["embedding"] for r in kept.orderBy(*order).limit(entries).collect()]
    flat = pa.array([[float(x) for x in s] for s in seeds], pa.list_(pa.float64()))
    numbers = whole_numbers(flat, width)
    bounds = tuple(width * p // parts for p in range(parts + 1))
    books = Codebooks(bounds, tuple(numbers[:, a:b].copy() for a, b in zip(bounds, bounds[1:])))
    for _ in range(rounds):
        sums = kept.select("embedding").mapInArrow(_sums(books), "at int, entry int, total long, n long")
        sums = sums.groupBy("at", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = [e.copy() for e in books.entries]
        part_of = np.repeat(np.arange(parts), np.diff(bounds))
        for row in sums.collect():  # at most width x entries
            part = part_of[row["at"]]
            moved[part][row["entry"], row["at"] - bounds[part]] = row["total"] // row["n"]
        books = Codebooks(bounds, tuple(moved))
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (a byte a part) and ``error``, the squared distance to what the code stands for.

    Null vectors, those with null or non-finite components and those of another width than the codebooks' are
    left out; repeated rows stay.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("vector_codes")
        for batch in batches:
            chosen, far = nearest(whole_numbers(batch.column("embedding"), books.width), books)
            codes = pa.array([row.tobytes() for row in chosen], pa.binary())
            arrays = [batch.column("vec_id"), batch.column("label"), codes, pa.array(far.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])
        return_free_memory()

    rows = finite(vectors.select("vec_id", "label", "embedding")).where(F.size("embedding") == books.width)
    types = dict(vectors.select("vec_id", "label").dtypes)
    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long")


def compressed(vectors: DataFrame) -> DataFrame:
    """Codes of all vectors with their error, the error summed over their label and the digest of the codebooks.

    ``code`` is in hex, two digits a part. Null labels form a label of their own, and a hot label is
    salted where its sum is joined back. An empty table gives an empty result.
    """
    books = fit(vectors)
    if books is None:
        empty = vectors.select("vec_id", "label").limit(0)
        return empty.select("vec_id", "label", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string"))))
    codes = stored(encode(vectors, books), "codes")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    sums = codes.groupBy(key.alias("_key")).agg(F.sum("error").alias("label_error"))
    joined = lookup_join(codes.withColumn("_key", key), sums, ["_key"], ["vec_id", "code"])
    return joined.select(
        "vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )
