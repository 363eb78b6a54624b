"""Byte-balanced shards by Karmarkar-Karp differencing over groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import keyed, stored, utf8
from turnspark.ranking import hash_rank, seeded_hash

SHARDS = 24
OVERHEAD = 8  # bytes counted for each document beside its text
TASK_GROUPS = 50_000  # expected groups that one task differences
FAN_IN = 512  # partial partitions that one task combines
EXCHANGES = 200  # of two parts between two sums, after differencing


def difference(parts: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions into one; sums and, for each part, the shard of each of its slots.

    ``parts`` holds at most ``shards`` sums each (a group is a part with one sum). The two parts
    with the largest spread are always joined, largest sums with smallest ones, until one is left.
    Exchanges with the largest or the smallest sum then narrow what spread is left.
    """
    heap, parents = [], []  # parents[i]: (partial, slot order) that part or partial i went into

    def push(sums: np.ndarray, number: int) -> None:
        heapq.heappush(heap, (int(sums.min()) - int(sums.max()), number, sums))

    for number, sums in enumerate(parts):
        full = np.zeros(shards, dtype=np.int64)
        full[: len(sums)] = sums
        push(full, number)
        parents.append(None)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        to_a, to_b = np.empty(shards, dtype=np.int64), np.empty(shards, dtype=np.int64)
        to_a[np.argsort(-x, kind="stable")] = np.arange(shards)
        to_b[np.argsort(y, kind="stable")] = np.arange(shards)
        sums = np.zeros(shards, dtype=np.int64)
        sums[to_a] += x
        sums[to_b] += y
        number = len(parents)
        parents.append(None)
        parents[a], parents[b] = (number, to_a), (number, to_b)
        push(sums, number)
    where: list = [np.arange(shards)] * len(parents)
    for number in range(len(parents) - 1, -1, -1):
        if parents[number] is not None:
            up, order = parents[number]
            where[number] = where[up][order]
    sums = _exchange(heap[0][2], parts, where)
    return sums.tolist(), [where[i][: len(p)].tolist() for i, p in enumerate(parts)]


def _exchange(sums: np.ndarray, parts: list[list[int]], where: list) -> np.ndarray:
    """Let two parts at a time trade their places in a larger and a smaller sum, one of them the largest or smallest if that helps.

    Where it does not, trades between two others change what the largest and smallest can trade next.
    """
    sums = sums.copy()
    held = np.zeros((len(parts) + 1, len(sums)), dtype=np.int64)  # the last row is no part: one may trade alone
    for i, p in enumerate(parts):
        held[i, where[i][: len(p)]] = p
    for _ in range(EXCHANGES):
        ranked = np.argsort(sums, kind="stable")
        pairs = chain(((ranked[-1], x) for x in ranked[:-1]), ((x, ranked[0]) for x in ranked[:0:-1]), combinations(ranked[-2:0:-1], 2))
        found = next(filter(None, (_trade(held[:, a] - held[:, b], int(sums[a] - sums[b]), a, b) for a, b in pairs)), None)
        if found is None:
            break
        top, low, numbers, total = found
        for number in numbers:
            held[number, [top, low]] = held[number, [low, top]]
            if number < len(parts):
                old = where[number]
                where[number] = np.where(old == top, low, np.where(old == low, top, old))
        sums[top] -= total
        sums[low] += total
    return sums


def _trade(moved: np.ndarray, gap: int, top: int, low: int) -> tuple | None:
    """(top, low, two parts, what they move) that narrows the gap most, if any two do."""
    if gap < 2:
        return None
    order = np.argsort(moved, kind="stable")
    sizes = moved[order]
    near = np.searchsorted(sizes, gap // 2 - sizes)
    mates = np.stack([near - 1, near, near + 1]).clip(0, len(order) - 1)
    total = sizes[mates] + sizes
    useful = (total > 0) & (total < gap) & (mates != np.arange(len(order)))
    if not useful.any():
        return None
    k, i = np.unravel_index(np.argmin(np.where(useful, np.abs(2 * total - gap), np.iinfo(np.int64).max)), total.shape)
    return top, low, (order[i], order[mates[k, i]]), int(total[k, i])


def _combine(shards: int) -> Callable:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        sums, slots = difference([list(s) for s in group["sums"]], shards)
        out = group[["id"]].assign(parent=key[0], slots=slots, total=None)
        out.at[0, "total"] = sums
        return out

    return run


def balanced(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``id`` and ``shard`` of every group (``id`` long, unique; ``size`` long).

    Groups are dealt by hash to tasks that difference their own part; the partial partitions, one
    row of ``shards`` sums each, are combined in the same way in further rounds of at most FAN_IN parts, so no
    task and no driver sees more than its share. The shard then follows the rounds back down.
    """
    kind = "id long, parent long, slots array<int>, total array<long>"
    level = groups.select("id", F.array("size").alias("sums"))
    count = max(1, -(-groups.count() // TASK_GROUPS))
    rounds = []
    while True:
        dealt = level.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(count)).cast("bigint"))
        rounds.append(stored(dealt.groupBy("part").applyInPandas(_combine(shards), kind), "difference"))
        if count == 1:
            break
        level = rounds[-1].where("total is not null").select(F.col("parent").alias("id"), F.col("total").alias("sums"))
        count = -(-count // FAN_IN)
    final = rounds[-1].select("id", F.col("slots").alias("shards"))
    for below in reversed(rounds[:-1]):
        up = final.select(F.col("id").alias("parent"), F.col("shards").alias("above"))
        moved = F.transform("slots", lambda s: F.col("above")[s])
        final = below.join(up, "parent").select("id", moved.alias("shards"))
    return final.select("id", F.col("shards")[0].alias("shard"))


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for every row of ``docs``.

    Equal texts (null counts as empty) form a group that stays in one shard, so a group above
    the mean size makes its shard larger than the rest. ``size`` is the text's UTF-8 bytes plus
    OVERHEAD. Slots number a shard's rows from 0 in the order of a hash of doc_id and row.
    """
    text = F.coalesce(utf8(F.col("row.text")), F.lit("").cast("binary"))
    rows = keyed(docs).select(
        "file", "place", F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = stored(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    shard = groups.select("id", "digest").join(balanced(groups.select("id", "size"), shards), "id").select("digest", "shard")
    placed = rows.join(shard, "digest").drop("digest")
    key = seeded_hash("slot", F.col("doc_id"), F.col("file"), F.col("place"))
    ranked = hash_rank(stored(placed, "placed"), key, F.struct("file", "place"), by=["shard"], name="rank", digits=3)
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"))
