"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import keyed, remember, slices, stored, utf8

SEQUENCE = 4096
END = 1  # id that closes every document
CACHE_WORDS = 600_000
JOINED = 300  # runs of letters that are tokenised as one text
#: Letters, then marks: parts that the public vocabulary tokenises one by one, the letters in lower case.
PARTED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
CLOSING = "</w>"  # of the last piece of each part
PARTING = ("[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", '"Lowercase"', f'"{CLOSING}"')  # what says so in its file
SHARD = 8192  # expected pieces of one problem
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
TIGHT = 0.97  # sequences less full than this are packed once more across problems

_KNOWN: dict[bytes, bytes] = {}
_TOKENIZER: list = []


def _forget() -> None:
    _KNOWN.clear()
    _TOKENIZER.clear()


def _tokenizer(source: str):
    from tokenizers import Tokenizer

    if not _TOKENIZER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(source)
        pieces = tokenizer.get_vocab()
        closes = np.zeros(max(pieces.values(), default=0) + 1, dtype=bool)
        closes[[i for piece, i in pieces.items() if piece.endswith(CLOSING)]] = True
        _TOKENIZER.extend((tokenizer, closes))
    return _TOKENIZER


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _letter_ids(tokenizer, closes: np.ndarray, runs: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Each run of lower-case letters with its ids; many runs are one text, cut again at closing pieces."""
    for low in range(0, len(runs), JOINED):
        group = runs[low : low + JOINED]
        (encoding,) = tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)
        ids = np.array(encoding.ids, dtype="<u4")
        data = ids.tobytes()
        ends = (4 * (np.nonzero(closes[ids])[0] + 1)).tolist()
        yield from zip(map(str.encode, group), map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)


def _learn(known: dict[bytes, bytes], fresh: list[bytes], source: str) -> None:
    """Add the ids of words to ``known``; those of letters and marks are put together from their parts."""
    tokenizer, closes = _tokenizer(source)
    parted, whole, letters = [], [], set()
    split = PARTED.fullmatch if all(sign in source for sign in PARTING) else lambda text: None
    for word in fresh:
        text = word.decode("utf-8", "replace")
        if found := split(text):
            letters.add(run := found[1].lower())
            marks = found[2].encode()
            parted.append((word, run.encode(), marks))
            if marks and marks not in known:
                known[marks] = _bytes(tokenizer.encode(found[2], add_special_tokens=False).ids)
        else:
            whole.append((word, text))
    known.update(_letter_ids(tokenizer, closes, [run for run in letters if run.encode() not in known]))
    for word, run, marks in parted:
        known[word] = known[run] + known[marks] if marks else known[run]
    for low in range(0, len(whole), 20_000):
        some = whole[low : low + 20_000]
        for (word, _), encoding in zip(some, tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
            known[word] = _bytes(encoding.ids)


def packed_ids(texts: list[bytes | None], source: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary's words never reach over white space, so each run between ASCII white space
    is tokenised by itself, once per worker while it is remembered.
    """
    known = _KNOWN
    if len(known) > CACHE_WORDS:
        known.clear()
    words = [(t or b"").split() for t in texts]
    fresh = list(set().union(*words).difference(known))
    if fresh:
        _learn(known, fresh, source)
    return [b"".join(map(known.__getitem__, some)) for some in words]


def pieces(docs: DataFrame, vocabulary: str, longest: int = SEQUENCE) -> DataFrame:
    """``file``, ``place``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece.

    A document is its ids and END; only longer ones are cut. Null texts count as empty.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # the fixed public vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "place", "doc_id", "piece", "start", "length", "ids_crc32"]
        close = np.array([END], dtype="<u4").tobytes()
        remember("packing", _forget)
        for batch in slices(batches, 128):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(packed_ids(batch.column("text").to_pylist(), source.value)):
                ids += close
                for number, low in enumerate(range(0, len(ids), 4 * longest)):
                    part = ids[low : low + 4 * longest]
                    owner.append(row)
                    piece.append(number)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [batch.column(c).take(pa.array(owner, pa.int64())) for c in names[:3]]
            arrays += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = keyed(docs).select("file", "place", F.col("row.doc_id").cast("bigint").alias("doc_id"), utf8(F.col("row.text")).alias("text"))
    return rows.mapInArrow(cut, "file long, place long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """One solution: bins of item numbers and their fills."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fills: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Put items, largest first, where the least room is left."""
        sizes, capacity = self.sizes, self.capacity
        room = sorted((capacity - fill, i) for i, fill in enumerate(self.fills))
        for item in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[item]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, i = room.pop(at)
            else:
                left, i = capacity, len(self.bins)
                self.bins.append([])
                self.fills.append(0)
            self.bins[i].append(item)
            self.fills[i] += size
            if left > size:
                insort(room, (left - size, i))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven fills."""
        return -len(self.bins), sum(f * f for f in self.fills)

    def without(self, gone: set[int]) -> tuple[Packing, list[int]]:
        """The bins that hold none of the items, and the other items of the bins left out."""
        out, displaced = Packing(self.sizes, self.capacity), []
        for items, fill in zip(self.bins, self.fills):
            if gone.isdisjoint(items):
                out.bins.append(items.copy())
                out.fills.append(fill)
            else:
                displaced += [i for i in items if i not in gone]
        return out, displaced

    def crossed(self, other: Packing, rng: random.Random) -> Packing:
        """Inject whole well-filled bins of the other, drop duplicates, best-fit what is displaced."""
        order = sorted(range(len(other.bins)), key=lambda i: -other.fills[i])
        some = [i for i in order[: len(order) // 2 + 1] if rng.random() < 0.5]
        child, displaced = self.without({x for i in some for x in other.bins[i]})
        for i in some:
            child.bins.append(other.bins[i].copy())
            child.fills.append(other.fills[i])
        emptiest = sorted(range(len(child.bins)), key=child.fills.__getitem__)[: max(1, len(child.bins) // 50)]
        for i in sorted(emptiest, reverse=True):
            displaced += child.bins.pop(i)
            child.fills.pop(i)
        child.best_fit(displaced)
        return child

    def genome(self) -> list[int]:
        out = [0] * len(self.sizes)
        for i, items in enumerate(self.bins):
            for item in items:
                out[item] = i
        return out

    @classmethod
    def of(cls, genome: list[int], sizes: list[int], capacity: int) -> Packing:
        out = cls(sizes, capacity)
        bins: dict[int, list[int]] = {}
        for item, i in enumerate(genome):
            bins.setdefault(i, []).append(item)
        out.bins = list(bins.values())
        out.fills = [sum(sizes[i] for i in items) for items in out.bins]
        return out


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]]) -> list[int]:
    """Best genome (bin of each item) of one island; stops as soon as no fewer bins are possible."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = [Packing.of(g, sizes, capacity) for g in elites]
    while len(people) < POPULATION:
        if people and len(people[0].bins) == least:
            break
        one = Packing(sizes, capacity)
        if people:  # a random part first, so that the members differ
            start = rng.sample(range(len(sizes)), len(sizes) // 4)
            one.best_fit(start)
            chosen = set(start)
            one.best_fit([i for i in range(len(sizes)) if i not in chosen])
        else:
            one.best_fit(list(range(len(sizes))))
        people.append(one)
        people.sort(key=Packing.fitness, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0].bins) <= least:
            break
        children = [a.crossed(b, rng) for a, b in (rng.sample(people, 2) for _ in people)]
        people = sorted(people + children, key=Packing.fitness, reverse=True)[: len(people)]
    return max(people, key=Packing.fitness).genome()


def _ordered(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["file", "place", "piece"], ignore_index=True)


def _islands(capacity: int) -> Callable:
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        remember("islands")
        if not len(items):
            return pd.DataFrame({"shard": [], "island": [], "genome": []})
        sizes = _ordered(items)["length"].tolist()
        genome = evolve(sizes, capacity, 1000 * int(key[0]) + int(key[1]), [list(g) for g in elites["genome"]])
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "genome": [genome]})

    return run


def _decoded(capacity: int) -> Callable:
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        items = _ordered(items)
        sizes = items["length"].tolist()
        best = max((Packing.of(list(g), sizes, capacity) for g in elites["genome"]), key=Packing.fitness) if len(items) else None
        bins, offsets, fills = [0] * len(items), [0] * len(items), [0] * len(items)
        for number, members in enumerate(best.bins if best else []):
            at = 0
            for i in members:
                bins[i], offsets[i], fills[i] = number, at, best.fills[number]
                at += sizes[i]
        return items[["file", "place", "piece", "length"]].assign(shard=key[0], bin=bins, offset=offsets, fill=fills)

    return run


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """``file``, ``place``, ``piece``, ``length``, ``shard``, ``bin``, ``offset``, ``fill`` of each item.

    Items are dealt by hash to problems of about SHARD pieces. Each problem evolves on ISLANDS
    islands; after an epoch every island hands its best solution on to the next one.
    """
    shards = max(1, -(-items.count() // SHARD))
    dealt = stored(items.withColumn("shard", F.pmod(F.xxhash64("file", "place", "piece"), F.lit(shards))), "items")
    copies = dealt.withColumn("island", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(ISLANDS)])))
    spark = items.sparkSession
    kind = "shard long, island long, genome array<int>"
    elites = spark.createDataFrame([], kind)
    for _ in range(EPOCHS):
        best = copies.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInPandas(_islands(capacity), kind)
        best = stored(best, "elites")
        moved = best.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        elites = best.union(moved)
    kind = "file long, place long, piece int, length long, shard long, bin long, offset long, fill long"
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_decoded(capacity), kind)


def pack(parts: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``file``, ``place``, ``piece``, ``sequence_id``, ``offset`` for pieces with ``length`` <= capacity.

    What lies in sequences filled below TIGHT after the first round is packed again in fresh
    problems, which leaves at most about one slack sequence for SHARD pieces of that remainder.
    """
    first = stored(_packed(parts.select("file", "place", "piece", "length"), capacity), "packed")
    number = F.shiftleft("shard", 32) + F.col("bin")
    done = first.where(F.col("fill") >= TIGHT * capacity).select("file", "place", "piece", (number * 2).alias("sequence_id"), "offset")
    loose = first.where(F.col("fill") < TIGHT * capacity).select("file", "place", "piece", "length")
    again = _packed(loose, capacity).select("file", "place", "piece", (number * 2 + 1).alias("sequence_id"), "offset")
    return done.union(again)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    Columns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    Repeated rows are packed once each; an empty table gives an empty result.
    """
    parts = stored(pieces(docs, vocabulary, capacity), "pieces")
    placed = pack(parts, capacity)
    return parts.join(placed, ["file", "place", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
