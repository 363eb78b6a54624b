"""Trie of conversation prefixes: vertical bitmaps of (position, turn), intersected depth first in shards of conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnspark.llm.tables import remember, return_free_memory, shuffle_partitions, stored
from turnspark.skew import lookup_join

SHARD = 1024  # consecutive conversation ids of a shard, one bit each
SHARED_UP_TO = 3  # most turns that a conversation can take from another one
STEP = 20  # conversations that share the first turns of one
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.md5(b"").digest()

NODE = (
    "shard long, path binary, parent binary, depth long, words long, first long, n long, "
    "pre int, size int, ends binary"
)


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn's role and text, as 16 bytes."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 1, ``turn`` (digest) and ``words``, in order of turn.

    Null turns come first and turns of one number go by their digest. Null roles and texts are
    empty, rows without a conversation are left out. Only digests are shuffled, never texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("at"),
        turn_digest(role, text).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    return stored(slim.select("conv_id", F.row_number().over(order).alias("pos"), "turn", "words"), "turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Numbered turns of every conversation after it took over the first turns of another one.

    Conversation c takes the first h turns (all, if there are fewer) of conversation c - c % STEP, h being the CRC-32 of
    its decimal id modulo 4, in place of its own first h. Remainders of negative ids go towards zero. Each conversation also has a
    row at position 0 without a turn. Positions ascend but may have gaps.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_UP_TO + 1)
    each = turns.where("pos = 1").select("conv_id", taken.alias("h"))
    none = F.lit(None)
    marks = each.select("conv_id", F.lit(0).alias("pos"), none.cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("words"))
    heads = turns.where(F.col("pos") <= SHARED_UP_TO).withColumnRenamed("conv_id", "base")
    base = each.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP)
    first = base.join(heads, "base").where("pos <= h").select("conv_id", "pos", "turn", "words")
    own = turns.where(F.col("pos") > taken)
    return marks.unionByName(first).unionByName(own)


@dataclass
class Index:
    """Vertical bitmaps of one shard.

    Bit b of ``postings[p][t]`` is set if the shard's b-th conversation has turn t at position p, bit b of
    ``lasting[p]`` if it has a turn at position p at all.
    """

    lines: list[list[int]]
    postings: list[dict[int, int]] = field(default_factory=list)
    lasting: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for bit, line in enumerate(self.lines):
            mask = 1 << bit
            while len(self.postings) < len(line):
                self.postings.append({})
                self.lasting.append(0)
            for at, turn in enumerate(line):
                here = self.postings[at]
                here[turn] = here.get(turn, 0) | mask
                self.lasting[at] |= mask

    def children(self, members: int, depth: int) -> list[tuple[int, int]]:
        """(turn, members) of each child: the parent's bitset met with the postings that its members name."""
        out = []
        rest = members & self.lasting[depth] if depth < len(self.lasting) else 0
        while rest:
            turn = self.lines[(rest & -rest).bit_length() - 1][depth]
            met = rest & self.postings[depth][turn]
            out.append((turn, met))
            rest ^= met
        return out


def nodes(lines: list[list[int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(parent's place, depth, last turn, members, ends) of a shard's nodes, a node before its subtree.

    ``members`` and ``ends`` are bitsets; the root's parent and turn are -1.
    """
    index = Index(lines)
    stack = [(-1, 0, -1, (1 << len(lines)) - 1)]
    place = 0
    while stack:
        parent, depth, turn, members = stack.pop()
        lasting = index.lasting[depth] if depth < len(index.lasting) else 0
        yield parent, depth, turn, members, members & ~lasting
        for child, met in reversed(index.children(members, depth)):
            stack.append((place, depth + 1, child, met))
        place += 1


def _shard_nodes(key: tuple, table: pa.Table) -> pa.Table:
    """Nodes of one shard with the path's digest, popcount and list of ends."""
    remember("prefix_trie")
    shard = key[0].as_py()
    conv, pos, words = (table.column(c).to_numpy() for c in ("conv_id", "pos", "words"))
    order = np.lexsort((pos, conv))
    order = order[pos[order] > 0]
    ids = np.unique(conv)
    digests = table.column("turn").take(pa.array(order)).combine_chunks().dictionary_encode()
    codes = digests.indices.to_numpy(zero_copy_only=False)
    names = digests.dictionary.to_pylist()
    weight = np.zeros(len(names), dtype=np.int64)
    weight[codes] = words[order]
    begin = np.searchsorted(conv[order], ids)
    lines = [line.tolist() for line in np.split(codes, begin[1:])]
    paths, rows = [], {n: [] for n in ("parent", "depth", "words", "first", "n", "ends", "above")}
    for above, depth, turn, members, ends in nodes(lines):
        paths.append(ROOT if above < 0 else hashlib.md5(paths[above] + names[turn]).digest())
        rows["parent"].append(None if above < 0 else paths[above])
        rows["depth"].append(depth)
        rows["words"].append(0 if above < 0 else int(weight[turn]))
        rows["first"].append(int(ids[(members & -members).bit_length() - 1]))
        rows["n"].append(members.bit_count())
        rows["ends"].append(_spread(ends, ids, shard) if ends else None)
        rows["above"].append(above)
    size = [1] * len(paths)
    for place in range(len(paths) - 1, 0, -1):
        size[rows["above"][place]] += size[place]
    out = {
        "shard": pa.array([shard] * len(paths), pa.int64()), "path": pa.array(paths, pa.binary()),
        "parent": pa.array(rows["parent"], pa.binary()),
        **{c: pa.array(rows[c], pa.int64()) for c in ("depth", "words", "first", "n")},
        "pre": pa.array(range(len(paths)), pa.int32()), "size": pa.array(size, pa.int32()), "ends": pa.array(rows["ends"], pa.binary()),
    }
    return pa.table(out)


def _spread(bits: int, ids: np.ndarray, shard: int) -> bytes:
    """A bitset over the shard's conversations as one over its range of ids, without zero bytes at its end."""
    out = 0
    while bits:
        low = bits & -bits
        out |= 1 << int(ids[low.bit_length() - 1] - shard * SHARD)
        bits ^= low
    return out.to_bytes((out.bit_length() + 7) // 8, "little")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each path's ends, for rows sorted by path and shard.

    Only the state of the hash is held, so that a list of any length passes.
    """
    path, state = None, None

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["path", "sha"]
        )

    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for here, shard, ends in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "ends"))):
            fresh = here != path
            if fresh:
                if state is not None:
                    done.append((path, state.hexdigest()))
                path, state = here, hashlib.sha256()
            bits = np.nonzero(np.unpackbits(np.frombuffer(ends, dtype=np.uint8), bitorder="little"))[0]
            text = ",".join(map(str, (bits + shard * SHARD).tolist()))
            state.update((text if fresh else "," + text).encode())
        yield rows(done)
    if state is not None:
        yield rows([(path, state.hexdigest())])
    return_free_memory()


def _subtree_sums(table: pa.Table) -> pa.Table:
    """Sums over each node's subtree within a shard: a run of places, as a node comes before its subtree."""
    order = np.argsort(table.column("pre").to_numpy())
    end = np.arange(len(order)) + table.column("size").to_numpy()[order]
    out = {"path": table.column("path").take(pa.array(order))}
    for name in ("saved", "leaf"):
        running = np.concatenate([[0], np.cumsum(table.column(name).to_numpy()[order])])
        out[name] = pa.array(running[end] - running[:-1])
    return pa.table(out)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie over the numbered turns of conversations (``rebuilt``), one row each.

    ``path`` (digest), ``parent``, ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. No conversation gives no node.

    A shard is a range of SHARD ids. In its task each (position, turn) has a bitset of conversations, and a depth-first
    walk meets each node's bitset with the postings of the next position. Shards are joined by the digest of the path, so
    that a prefix that very many conversations share is one row a shard. Sums over a subtree are sums
    over a run of places within each shard, in which a node's value counts only in the shard of its smallest member. A task holds
    the digests of one shard's turns, so the longest conversation bounds it.
    """
    spread = turns.withColumn("shard", F.expr(f"(conv_id - pmod(conv_id, {SHARD})) div {SHARD}"))
    local = stored(spread.groupBy("shard").applyInArrow(_shard_nodes, NODE), "trie-nodes")
    merged = local.groupBy("path").agg(
        F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"),
        *(F.first(c).alias(c) for c in ("parent", "depth", "words")),
    )
    merged = stored(merged, "trie-paths")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    known = stored(merged.join(children, "path", "left").fillna(0, ["n_children"]), "trie-children")
    values = known.select(
        "path", F.col("conv_id").alias("first"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    # by path and smallest member: each node's value lands in one shard, and no path is a hot key
    placed = local.select("shard", "path", "first", "pre", "size").join(values, ["path", "first"], "left").fillna(0, ["saved", "leaf"])
    sums = placed.groupBy("shard").applyInArrow(_subtree_sums, "path binary, saved long, leaf long")
    sums = sums.groupBy("path").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = local.where("ends is not null").select("path", "shard", "ends")
    ends = ends.repartition(shuffle_partitions(turns.sparkSession), "path").sortWithinPartitions("path", "shard")
    ends = ends.mapInArrow(_end_digests, "path binary, sha string")
    nodes_ = known.join(sums, "path").join(ends, "path", "left")
    above = merged.select(F.hex("path").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    nodes_ = lookup_join(nodes_.withColumn("_above", F.hex("parent")), above, ["_above"], ["path"], how="left")
    return nodes_.select(
        "path", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
