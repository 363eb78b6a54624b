"""Counting the n-grams of tokens, many rows at a time: on Arrow batches, inside tasks.

An n-gram is cut once for the different words of a run of rows, not once for each time that it is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENS = 1 << 18  # of the rows that are counted at once


def _repeated(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, rising, and how often each is there)."""
    if times is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(times, starts) if len(key) else times


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of runs of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _pieces(words: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(pieces of each blank-padded word, numbers of the pieces, pieces)."""
    known: dict[str, int] = {}
    numbers: list[int] = []
    sizes = np.empty(len(words), dtype=np.int64)
    for k, word in enumerate(words):
        padded = f" {word} "
        n = len(padded)
        found = [padded[i : i + low] for i in range(max(n - low + 1, 1))]
        for size in range(low + 1, min(high, n) + 1):
            found += [padded[i : i + size] for i in range(n - size + 1)]
        numbers += [known.setdefault(piece, len(known)) for piece in found]
        sizes[k] = len(found)
    return sizes, np.array(numbers, dtype=np.int64), list(known)


def counted(tokens: pa.ListArray, owner: np.ndarray, unit: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(owner, number of the n-gram, how often) by owner and number, and the n-grams; ``owner`` numbers what the rows count for."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(sizes)), sizes)
    if unit == "char":
        key, times = _repeated(owner[row] * max(len(words), 1) + code)
        word = key % max(len(words), 1)
        each, piece, terms = _pieces(words.to_pylist(), low, high)
        size = each[word]
        place = _expanded((np.cumsum(each) - each)[word], size)
        who = np.repeat(key // max(len(words), 1), size)
        key, times = _repeated(who * max(len(terms), 1) + piece[place], np.repeat(times, size))
        return key // max(len(terms), 1), key % max(len(terms), 1), times, pa.array(terms, pa.string())
    parts, names, first = [], [], 0
    run, known = code, words
    for n in range(1, high + 1):
        if n > 1:
            whole = row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool)
            start = np.nonzero(whole)[0]
            pairs, at = np.unique(run[start] * max(len(words), 1) + code[start + n - 1], return_inverse=True)
            known = pc.binary_join_element_wise(
                known.take(pa.array(pairs // max(len(words), 1))), words.take(pa.array(pairs % max(len(words), 1))), " ")
            run = np.full(len(code), -1)
            run[start] = at
        else:
            start = np.arange(len(code))
        if n >= low:
            parts.append((owner[row[start]], run[start] + first))
            names.append(known)
            first += len(known)
    key, times = _repeated(np.concatenate([o * max(first, 1) + c for o, c in parts]))
    return key // max(first, 1), key % max(first, 1), times, pa.concat_arrays([n.cast(pa.string()) for n in names])


def runs(batches: Iterator[pa.RecordBatch], column: str, tokens: str, most: int = TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows of some ``most`` tokens with a number for each value of ``column``, whose rows come one after the other.

    Rows of one value are never parted.
    """
    rest: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        nonlocal rest
        table = table.combine_chunks()
        rest = table
        if not len(table):
            return
        coded = table.column(column).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.r_[0, np.nonzero(coded[1:] != coded[:-1])[0] + 1]
        size = np.cumsum(table.column(tokens).combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.r_[new, len(table)] if last else new
        at = 0
        while at < edges[-1]:
            below = edges[edges <= np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")]
            stop = below[-1] if len(below) and below[-1] > at else edges[np.searchsorted(edges, at, side="right")]
            part = table.slice(at, stop - at).combine_chunks().to_batches()[0]
            yield part, np.cumsum(np.r_[False, coded[at + 1 : stop] != coded[at : stop - 1]])
            at = int(stop)
        rest = table.slice(at)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from cut(table if rest is None or not len(rest) else pa.concat_tables([rest, table]), False)
    if rest is not None and len(rest):
        yield from cut(rest, True)
