"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a longer character into a blank.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
FOLDED = np.frombuffer(FOLD, dtype=np.uint8)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CHUNK_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 0 to n."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


@dataclass
class Parsed:
    """Lower-cased bytes of some whole lines, with their lines and words.

    Line i has the bytes ``low[line_start[i]:line_end[i]]`` and number ``line_number[i]`` in text
    ``line_text[i]``; word j has the hash ``word_hash[j]`` and is in line ``word_line[j]``.
    """

    low: bytes
    line_start: np.ndarray
    line_end: np.ndarray
    line_text: np.ndarray
    line_number: np.ndarray
    word_line: np.ndarray
    word_hash: np.ndarray


def _chunks(offsets: np.ndarray, data: np.ndarray, cut_texts: bool) -> Iterator[tuple[list[tuple[int, int, int]], int, int]]:
    """Pieces of about CHUNK_BYTES: ((text, end, first line number) for each part), start, end.

    Texts are cut after a line feed only, so memory follows the chunk or one longer line (one
    longer text, if texts are not to be cut).
    """
    parts, start = [], int(offsets[0])
    for text in range(len(offsets) - 1):
        low, high, number = int(offsets[text]), int(offsets[text + 1]), 0
        while cut_texts and high - low > CHUNK_BYTES:
            feeds = np.nonzero(data[low + CHUNK_BYTES : high] == 0x0A)[0]
            if not len(feeds):
                break
            cut = low + CHUNK_BYTES + int(feeds[0]) + 1
            parts.append((text, cut - 1, number))
            number += int(np.count_nonzero(data[low:cut] == 0x0A))
            yield parts, start, cut - 1  # the line feed itself separates this part from the next
            parts, start, low = [], cut, cut
        parts.append((text, high, number))
        if high - start > CHUNK_BYTES:
            yield parts, start, high
            parts, start = [], high
    if parts:
        yield parts, start, int(offsets[-1])


def parse(texts: pa.Array, fold: bool = False) -> Iterator[Parsed]:
    """Lines (split at line feeds) and words (runs outside blank, tab, feeds and return) of binary texts.

    Null texts have no bytes and one empty line. With ``fold`` words are those of ``folded_words``
    and each text is one line.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for parts, start, end in _chunks(offsets, data, not fold):
        low = (FOLDED if fold else LOWER)[data[start:end]]
        word = ~BLANK[low]
        ends = np.array([e - start for _, e, _ in parts], dtype=np.int64)
        feeds = np.nonzero(low == 0x0A)[0]
        bounds = np.sort(np.concatenate([feeds + 1, ends]))
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        inner = ends[(ends > 0) & (ends < len(low))]
        begin[inner] = word[inner]
        stop[inner - 1] = word[inner - 1]
        first, last = np.nonzero(begin)[0], np.nonzero(stop)[0]
        powers, inverse = _powers(len(low))
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[: len(low)], out=total[1:])
        mixed = (total[last + 1] - total[first]) * inverse[first]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        here = np.searchsorted(feeds, ends, side="left")
        counts = np.diff(np.concatenate([[0], here])) + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        number = np.arange(len(owner)) - before[owner] + np.array([n for _, _, n in parts], dtype=np.int64)[owner]
        line_start = np.concatenate([[0], bounds[:-1]])
        is_end = np.zeros(len(bounds), dtype=bool)
        is_end[np.cumsum(counts) - 1] = True
        line_end = np.where(is_end, bounds, bounds - 1)
        yield Parsed(
            low.tobytes(), line_start, line_end, np.array([t for t, _, _ in parts], dtype=np.int64)[owner], number,
            np.searchsorted(bounds, first, side="right"), mixed,
        )


def folded_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lower-cased; null has none."""
    return (text or b"").translate(FOLD).split()
