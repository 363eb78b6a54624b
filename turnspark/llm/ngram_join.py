"""Documents with similar word shingles: groups of similar sets, bounds on a group's token union, opened where a bound allows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.llm.components import components
from turnspark.llm.tables import from_files, keyed, release, remember, return_free_memory, shuffle_partitions, slices, stored, utf8
from turnspark.llm.words import parse
from turnspark.skew import lookup_join

WORDS = 5  # of a shingle
PERCENT = 80  # least similarity
COUNTERS = 1 << 18  # shingle counters of the rarity order; any total order gives the same result
MEMBERS = 64  # of a group, one bit each
GROUP_TOKENS = 1 << 18  # tokens at which a group takes no further member
QUERIES = 512  # of an opened group in one task
LONG = 64  # rows of a token's run beyond which its rows are first compared with one of them
PRODUCT_ROWS = 4096  # tokens of a group that are counted between its members at once
SEEN = 1 << 18  # sets that a task remembers to skip its own repeats
MAP_BITS = (16, 27)  # smallest and largest bitmap of wanted sets, as powers of two
KEY_DIGITS = 15  # hex digits of a set's digest that its bitmap key is made of

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of each binary text.

    A-Z count as a-z; words are runs outside blank, tab, feeds and return. A text of fewer words has its
    whole sequence as one shingle, one without words none.
    """
    owner, word = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for part in parse(texts):
        owner.append(part.line_text[part.word_line])
        word.append(part.word_hash)
    owner, word = np.concatenate(owner), np.concatenate(word)
    count = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(count) - count
    left = np.arange(len(word)) - begin[owner]  # words before this one in its text
    size = np.minimum(count, words)[owner]
    first = np.nonzero(left + size <= count[owner])[0]
    value = np.zeros(len(first), dtype=np.uint64)
    for i in range(words):
        inside = i < size[first]
        value += np.where(inside, word[np.where(inside, first + i, 0)] * _MIX[i % len(_MIX)] + np.uint64(i), np.uint64(0)) if len(word) else 0
    value += size[first].astype(np.uint64)
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    owner = owner[first]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), value


def set_id(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n shares with any set that reaches the similarity."""
    return -(-percent * n // 100)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of every text's set; in the end one row with the task's shingle counters."""
    remember("ngram_join")
    counters = np.zeros(COUNTERS, dtype=np.int64)
    names = ["file", "place", "doc_id", "n", "cls", "counts"]
    for batch in slices(batches):
        offsets, hashes = shingle_sets(batch.column("text"))
        counters += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        ids = [set_id(hashes[a:b]) if b > a else None for a, b in zip(offsets, offsets[1:])]
        arrays = [batch.column(c) for c in names[:3]]
        arrays += [pa.array(np.diff(offsets), pa.int64()), pa.array(ids, pa.string()), pa.nulls(len(ids), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    last = (None, None, None, None, None, zlib.compress(counters.tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names=names)


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for value in batch.column("counts"):
            total += np.frombuffer(zlib.decompress(value.as_py()), dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["counts"])


def _rarity(scan: DataFrame) -> np.ndarray:
    """Step of each counter, by how many times its mean it holds: 0 for all but frequent shingles."""
    parts = scan.where("counts is not null").select("counts").mapInArrow(_add_counters, "counts binary")
    total = np.zeros(COUNTERS, dtype=np.int64)
    for row in parts.coalesce(16).mapInArrow(_add_counters, "counts binary").collect():  # at most 16 fixed-size rows
        total += np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    share = np.maximum(total, 1) / max(total.mean(), 1)
    return np.maximum(np.floor(np.log2(share)), 0).astype(np.uint8)


def ranked(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Tokens of a set, rare ones first: the step of the counter before the leading bits of the hash."""
    step = steps[(hashes % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
    return np.sort(step << np.uint64(56) | hashes >> np.uint64(8))


def _prefixes(steps: np.ndarray, percent: int) -> Callable:
    """The tokens that a set must share one of with each similar set, for every distinct set of a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in slices(batches):
            offsets, hashes = shingle_sets(batch.column("text"))
            if len(seen) > SEEN:
                seen.clear()
            ids, sizes, tokens, lead = [], [], [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                name = set_id(hashes[a:b])
                if a == b or name in seen:
                    continue
                seen.add(name)
                n = b - a
                some = ranked(hashes[a:b], steps)[: n - int(least_shared(n, percent)) + 1]
                ids.append(name)
                sizes.append(n)
                tokens.append(some.tobytes())
                lead.append([int(some[0]), int(some[min(1, len(some) - 1)])])
            lead = np.array(lead, dtype=np.int64).reshape(-1, 2)
            arrays = [pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(lead[:, 0]), pa.array(lead[:, 1]), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["cls", "n", "t0", "t1", "tokens"])

    return emit


def _within(tokens: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a group may be similar to another one, by the tokens that their prefixes share."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, code, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    code, owner = (new[code][count[code] > 1], owner[count[code] > 1])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    shared = np.zeros((len(tokens), len(tokens)))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, PRODUCT_ROWS):
        a, b = np.searchsorted(code, [low, low + PRODUCT_ROWS])
        met = np.zeros((PRODUCT_ROWS, len(tokens)), dtype=np.float32)
        met[code[a:b] - low, owner[a:b]] = 1
        shared += met.T @ met
    n, m = sizes[:, None], sizes[None, :]
    may = shared + np.maximum(least_shared(n, percent), least_shared(m, percent)) - 1
    fits = (shared > 0) & ((100 + percent) * may >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    np.fill_diagonal(fits, False)
    return fits.any(axis=1)


def _grouped(percent: int) -> Callable:
    """Number the sets, sorted by their rarest tokens, in groups of up to MEMBERS neighbours.

    ``member`` is the group's number and the place in it; ``mates`` tells whether it may have a similar set inside the group.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 27  # groups of a partition
        held: list[tuple[str, int, bytes]] = []
        total, last = 0, None

        def group() -> pa.RecordBatch:
            sizes = np.array([n for _, n, _ in held], dtype=np.int64)
            mates = _within([np.frombuffer(t, dtype="<u8") for _, _, t in held], sizes, percent)
            columns = [
                pa.array((number << 6) + np.arange(len(held))), pa.array([c for c, _, _ in held]), pa.array(sizes),
                pa.array(mates), pa.array([t for _, _, t in held], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["member", "cls", "n", "mates", "tokens"])

        for batch in batches:
            for name, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "tokens"))):
                if name == last:
                    continue
                last = name
                if held and (len(held) == MEMBERS or total + len(tokens) // 8 > GROUP_TOKENS):
                    yield group()
                    number, held, total = number + 1, [], 0
                held.append((name, n, tokens))
                total += len(tokens) // 8
        if held:
            yield group()
        return_free_memory()

    return emit


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of a member with the member's size and the token's place."""
    for batch in slices(batches):
        tokens = [np.frombuffer(t, dtype="<i8") for t in batch.column("tokens").to_pylist()]
        size = np.array([len(t) for t in tokens])
        token = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        member, n = (np.repeat(batch.column(c).to_numpy(), size) for c in ("member", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, member, n, place)], names=["token", "member", "n", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by token, whose token has another row; ``far`` from the run's LONG-th row on.

    A batch's last row waits for the next batch; only it and its place in the run are held.
    """
    names = ["token", "member", "n", "place"]
    last, passed = None, 0  # the waiting row, rows before it in its run

    def out(rows: np.ndarray, rank: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows[i][keep]) for i in range(4)] + [pa.array(rank[keep] >= LONG)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "far"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in names])
        if last is not None:
            rows = np.concatenate([last, rows], axis=1)
        if not rows.shape[1]:
            continue
        token = rows[0]
        begins = np.r_[True, token[1:] != token[:-1]]
        at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
        rank = np.arange(len(token)) - at + np.where(at == 0, passed, 0)
        keep = np.r_[token[1:] == token[:-1], False] | (rank > 0)
        keep[-1] = False
        yield out(rows, rank, keep)
        last, passed = rows[:, -1:].copy(), int(rank[-1])
    if last is not None:
        yield out(last, np.array([passed]), np.array([passed > 0]))
    return_free_memory()


def _fits(percent: int) -> Column:
    """Whether two sets (n and n2) that share the tokens at place and place2 leave room for the similarity."""
    n, m, i, j = (F.col(c) for c in ("n", "n2", "place", "place2"))
    may = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (may * (100 + percent) >= (n + m) * percent)


def _by_group(pairs: DataFrame) -> DataFrame:
    """(q, g, bits): the group of s with the places in it that are to be compared with q."""
    bit = F.expr(f"shiftleft(1L, cast(s & {MEMBERS - 1} as int))")
    return pairs.groupBy("q", F.shiftright("s", 6).alias("g")).agg(F.bit_or(bit).alias("bits"))


def _wanted(keys: DataFrame) -> bytes:
    """Bitmap over the low bits of ``key``, of 16 bits a key up to the largest size; other keys may match by chance."""
    power = min(max(int(16 * keys.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    low = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    words = keys.groupBy(F.shiftright(low, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(31 & key as int))")).alias("bits"))
    out = np.zeros(1 << power - 5, dtype="<u4")
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.tobytes()


def _whole_sets(bits: bytes) -> Callable:
    """Digest and hashes of the sets whose bit is set in the bitmap."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits, dtype=np.uint8)
        mask = len(wanted) * 8 - 1
        seen: set[str] = set()
        for batch in slices(batches):
            offsets, hashes = shingle_sets(batch.column("text"))
            if len(seen) > SEEN:
                seen.clear()
            ids, sets = [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                name = set_id(hashes[a:b])
                key = int(name[:KEY_DIGITS], 16) & mask
                if b > a and wanted[key >> 3] >> (key & 7) & 1 and name not in seen:
                    seen.add(name)
                    ids.append(name)
                    sets.append(hashes[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sets, pa.binary())], names=["cls", "hashes"])

    return emit


class Group:
    """Token union of a group's members, with one bit a member for each token."""

    def __init__(self, members: list[int], sets: list[np.ndarray]):
        self.members, self.sizes = members, np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        self.union, code = np.unique(every, return_inverse=True)
        self.bits = np.zeros(len(self.union), dtype=np.uint64)
        place = np.repeat(np.arange(len(sets)), self.sizes)
        np.bitwise_or.at(self.bits, code, np.uint64(1) << place.astype(np.uint64))

    def similar(self, query: np.ndarray, percent: int) -> list[int]:
        """Places of the members that reach the similarity with the query; none without opening, if the union rules all out."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if len(at) < least_shared(len(query), percent) or 100 * len(at) < percent * self.sizes.min():
            return []
        shared = np.unpackbits(self.bits[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        shared = shared.sum(axis=0, dtype=np.int64)[: len(self.members)]
        return np.nonzero(100 * shared >= percent * (len(query) + self.sizes - shared))[0].tolist()


def _open_groups(percent: int, forest: bool) -> Callable:
    """Links of the queries of each group, for rows sorted by group, salt and kind (members before queries).

    Holds one group at a time. With ``forest`` links that join nothing new within the task's group are left out.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("ngram_join")
        here, members, sets, group, root = None, [], [], None, {}
        found: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def link(a: int, b: int) -> None:
            if forest:
                a_, b_ = top(a), top(b)
                if a_ == b_:
                    return
                root[a_] = b_
            found.append((a, b))

        def close(own: bool) -> Group | None:
            if not members:
                return None
            made = Group(members, sets)
            if own:
                for i, values in enumerate(sets):
                    for j in made.similar(values, percent):
                        if j < i:
                            link(members[i], members[j])
            return made

        own = False
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("g", "salt", "q", "bits", "own", "hashes"))
            for g, salt, q, bits, mine, raw in zip(*columns):
                if here != (g, salt):
                    if group is None:
                        close(own)
                    here, members, sets, group, root, own = (g, salt), [], [], None, {}, mine
                values = np.frombuffer(raw, dtype="<u8")
                if bits == 0:  # a member
                    members.append(q)
                    sets.append(values)
                    continue
                if group is None:
                    group = close(own)
                for j in group.similar(values, percent) if group else ():
                    if bits >> (members[j] & MEMBERS - 1) & 1 and members[j] != q:
                        link(q, members[j])
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            found = []
        if group is None:
            close(own)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        return_free_memory()

    return emit


def _verified(found: DataFrame, own: DataFrame, groups: DataFrame, text: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Links among candidates (q, g, bits) and inside the groups of ``own`` (g, bits), by whole sets."""
    spark = text.sparkSession
    nothing = F.lit(0).cast("bigint")
    opened = found.groupBy("g").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("queries"), nothing.alias("own"))
    opened = opened.unionByName(own.select("g", "bits", nothing.alias("queries"), F.lit(1).cast("bigint").alias("own")))
    opened = opened.groupBy("g").agg(F.bit_or("bits").alias("bits"), F.sum("queries").alias("queries"), F.max("own").alias("own"))
    opened = stored(opened.withColumn("salts", F.greatest(F.ceil(F.col("queries") / QUERIES), F.lit(1))), "opened")
    bit = F.expr(f"filter(sequence(0L, {MEMBERS - 1}L), i -> shiftright(bits, cast(i as int)) & 1 = 1)")
    inside = opened.select("g", "salts", "own", F.explode(bit).alias("i")).select("g", "salts", "own", (F.shiftleft("g", 6) + F.col("i")).alias("member"))
    some = inside.select("member").union(found.select("q")).distinct()
    members = stored(groups.select("member", "cls").join(some, "member"), "wanted")
    key = F.conv(F.substring("cls", 1, KEY_DIGITS), 16, 10).cast("bigint").alias("key")
    bits = spark.sparkContext.broadcast(_wanted(members.select(key)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole_sets(bits.value)(batches)

    sets = text.mapInArrow(whole, "cls string, hashes binary").groupBy("cls").agg(F.first("hashes").alias("hashes"))
    sets = stored(sets.join(members, "cls").select("member", "hashes"), "sets")
    release(spark)
    inside = inside.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    own_salt = (F.col("own") == 1) & (F.col("salt") == 0)
    rows = inside.select("member", "g", "salt", nothing.alias("bits"), own_salt.alias("own"))
    salt = F.pmod(F.xxhash64("member"), F.col("salts"))
    queries = found.withColumnRenamed("q", "member").join(opened.select("g", "salts"), "g")
    rows = rows.unionByName(queries.select("member", "g", salt.alias("salt"), "bits", F.lit(False).alias("own")))
    both = rows.join(sets, "member").select("g", "salt", F.col("member").alias("q"), "bits", "own", "hashes")
    both = both.withColumn("kind", F.col("bits") != 0)
    both = both.repartition(shuffle_partitions(spark), "g", "salt").sortWithinPartitions("g", "salt", "kind")
    return both.drop("kind").mapInArrow(_open_groups(percent, forest), "a long, b long")


def _index(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shingled documents, texts, groups, runs of shared tokens); all but the texts are stored."""
    spark = docs.sparkSession
    rows = keyed(docs).select("file", "place", F.col("row.doc_id").cast("bigint").alias("doc_id"), utf8(F.col("row.text")).alias("text"))
    scan = stored(rows.mapInArrow(_scan, "file long, place long, doc_id long, n long, cls string, counts binary"), "shingled")
    steps = spark.sparkContext.broadcast(_rarity(scan))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(steps.value, percent)(batches)

    text = rows.select("text")
    sets = text.mapInArrow(prefixes, "cls string, n long, t0 long, t1 long, tokens binary")
    # rebalancing splits a token that leads very many sets; its parts only form more groups
    near = sets.hint("rebalance", "t0").sortWithinPartitions("t0", "t1", "cls").select("cls", "n", "tokens")
    groups = stored(near.mapInArrow(_grouped(percent), "member long, cls string, n long, mates boolean, tokens binary"), "groups")
    release(spark)
    flat = groups.select("member", "n", "tokens").mapInArrow(_flat, "token long, member long, n long, place long")
    flat = flat.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token")
    runs = stored(flat.mapInArrow(_shared, "token long, member long, n long, place long, far boolean"), "runs")
    release(spark)
    return scan.where("counts is null").drop("counts"), text, groups, runs


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(q, s, shared, n, both), q > s: members of different ``root`` with the number of tokens that they share among the rows.

    ``n`` is the larger of their sizes, ``both`` the sum.
    """
    other = rows.select("token", *(F.col(c).alias(f"{c}2") for c in ("member", "n", "place", "root")))
    met = rows.join(other, "token").where((F.col("root") != F.col("root2")) & (F.col("member") > F.col("member2")) & _fits(percent))
    return met.groupBy(F.col("member").alias("q"), F.col("member2").alias("s")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(F.greatest("n", "n2")).alias("n"), F.max(F.col("n") + F.col("n2")).alias("both")
    )


def _may_reach(shared: Column, percent: int) -> Column:
    """Whether sets whose prefixes share so many tokens may be similar.

    Of two prefixes the one that ends at the rarer token has all its shared tokens in the other as well, so that two sets share at
    most the tokens that the prefixes share and what lies behind one of them.
    """
    may = shared + F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9) - 1
    return may * (100 + percent) >= F.col("both") * percent


def _same_sets(groups: DataFrame) -> DataFrame:
    """Links from the members that hold one set to the smallest of them; sets are seldom in two groups."""
    each = groups.groupBy("cls").agg(F.min("member").alias("b"), F.count(F.lit(1)).alias("n"))
    return groups.select("cls", F.col("member").alias("a")).join(each.where("n > 1"), "cls").select("a", "b").where("a <> b")


def similar_pairs(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): all links ``cls``, ``cls2`` between different sets, and ``file``, ``place``, ``doc_id``, ``n``, ``cls``.

    Documents of one set share its ``cls``; copies are not expanded. Work follows the number of candidate pairs.
    """
    docs = from_files(docs)
    shingled, text, groups, runs = _index(docs, percent)
    met = _met(runs.withColumn("root", F.col("member")), percent).where(_may_reach(F.col("shared"), percent))
    found = stored(_by_group(met), "candidates")
    own = groups.limit(0).select(F.col("member").alias("g"), F.col("n").alias("bits"))
    links = _verified(found, own, groups, text, percent, forest=False)
    named = groups.select("member", "cls")
    pairs = links.join(named.toDF("a", "cls"), "a").join(named.toDF("b", "cls2"), "b")
    pairs = pairs.select(F.least("cls", "cls2").alias("cls"), F.greatest("cls", "cls2").alias("cls2")).where("cls <> cls2").distinct()
    return pairs, shingled


def linked_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``file``, ``place``, ``doc_id``, ``n_shingles`` and ``component_id``, a row for every row of ``docs``.

    Two documents are linked if ``percent`` or more of the distinct five-word shingles of both are common; a text of fewer
    words has its whole sequence as its one shingle. Null texts and those without words are linked with nothing.
    ``component_id`` is the smallest doc_id reachable by links, null doc_ids aside; rows of one doc_id are rows of their own.

    Equal sets become one. The sets, sorted by their rarest tokens, are cut into groups of neighbours. A set needs
    a token in its prefix (rare tokens first) in common with any similar one: the runs of such
    tokens name the groups that a set has to meet. A query that shares fewer of its shingles with the
    union of a group's sets than any link needs is done with it; else the group is opened and the sets are
    compared, all shingles of them. First groups are opened for their own members, for the candidates of short runs and, where very many
    sets share a token, for one central set of the run; after that only pairs of different components in long runs are left.
    """
    docs = from_files(docs)
    shingled, text, groups, runs = _index(docs, percent)
    itself = runs.withColumn("root", F.col("member"))
    many = stored(runs.where("far").select("token").distinct(), "long-runs")
    few = itself.join(many, "token", "left_anti")
    long_ = stored(runs.join(many, "token", "left_semi").select("token", "member", "n", "place"), "long-rows")
    weight = stored(long_.groupBy("member").agg(F.count(F.lit(1)).alias("weight")), "weights")
    met = stored(_met(few, percent), "met")
    sure = met.where(_may_reach(F.col("shared"), percent)).select("q", "s")
    # the set with most tokens in long runs is nearest to what a run's sets have in common
    centre = long_.join(weight, "member").groupBy("token").agg(F.max(F.struct("weight", "member", "n", "place")).alias("c"))
    centre = centre.select("token", F.col("c.member").alias("s"), F.col("c.n").alias("n2"), F.col("c.place").alias("place2"))
    star = lookup_join(long_, centre, ["token"], ["member"]).where((F.col("member") != F.col("s")) & _fits(percent))
    found = stored(_by_group(sure.union(star.select("member", "s")).distinct()), "candidates")
    bit = F.expr(f"shiftleft(1L, cast(member & {MEMBERS - 1} as int))")
    own = groups.where("mates").groupBy(F.shiftright("member", 6).alias("g")).agg(F.bit_or(bit).alias("bits"))
    links = stored(_verified(found, own, groups, text, percent, forest=True).union(_same_sets(groups)), "links")
    release(docs.sparkSession)
    roots = stored(components(links), "roots")
    rooted = long_.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    late = _met(rooted.join(mixed, "token", "left_semi"), percent).withColumn("before", F.lit(0).cast("bigint"))
    early = met.withColumn("before", F.col("shared")).join(weight.select(F.col("member").alias("q")), "q", "left_semi")
    early = early.join(weight.select(F.col("member").alias("s")), "s", "left_semi").select(late.columns)
    both = late.union(early).groupBy("q", "s").agg(*(F.sum(c).alias(c) for c in ("shared", "before")), *(F.max(c).alias(c) for c in ("n", "both")))
    rest = both.where((F.col("shared") > F.col("before")) & _may_reach(F.col("shared"), percent) & ~_may_reach(F.col("before"), percent))
    rest = stored(_by_group(rest), "candidates")
    if not rest.isEmpty():
        none = own.limit(0)
        links = stored(links.union(_verified(rest, none, groups, text, percent, forest=True)), "links")
        release(docs.sparkSession)
        roots = stored(components(links), "roots")
    node = groups.groupBy("cls").agg(F.min("member").alias("node"))
    first = shingled.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(node.join(first, "cls").join(roots, "node", "left").select("cls", "doc_id", F.coalesce("root", "node").alias("root")), "sets")
    least = sets.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    sets = lookup_join(sets, least, ["root"], ["cls"]).select("cls", "component_id")
    full = lookup_join(shingled.where("cls is not null"), sets, ["cls"], ["file", "place"])
    bare = shingled.where("cls is null").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(bare).select("file", "place", "doc_id", F.col("n").alias("n_shingles"), "component_id")
