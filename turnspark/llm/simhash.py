"""SimHash near-duplicates found through Golay codewords of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.llm.components import components
from turnspark.llm.tables import from_files, keyed, slices, stored, utf8

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = (22, 21, 21)  # bits of a fingerprint from the low end; each fits the 23-bit code
GENERATOR = 0xAE3  # generator polynomial of the binary Golay code [23, 12, 7]
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes.

    Words are runs of bytes outside blank, tab, line feed, vertical tab, form feed and return;
    A-Z count as a-z. Texts with fewer words than a shingle are one shingle; no words: zero.
    Hashes are taken in blocks, so memory for long texts stays near the size of the text.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    last = ends[shingle - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(last), BLOCK):
        spans = zip(starts[low : low + BLOCK], last[low : low + BLOCK])
        hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        columns = [batch.column(c) for c in ("file", "place", "doc_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], names=["file", "place", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``file``, ``place`` (see ``keyed``), ``doc_id`` and ``fp`` (the fingerprint as a signed long)."""
    narrow = keyed(docs).select(
        "file", "place", F.col("row.doc_id").cast("bigint").alias("doc_id"), utf8(F.col("row.text")).alias("text")
    )
    return narrow.mapInArrow(_fingerprints, "file long, place long, doc_id long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all 23-bit words by the generator and the error of weight <= 3 for each."""
    words = np.arange(1 << 23, dtype=np.int32)
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    rest = rest.astype(np.int16)
    single = [1 << b for b in range(23)]
    errors = np.zeros(1 << 11, dtype=np.int32)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                word = single[i] | single[j] | single[k]
                errors[rest[word]] = word
    return rest, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    rest, errors = _code()
    return (words ^ errors[rest[words]]) >> 11


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the codewords that decode the words with none or one of ``bits`` bits flipped.

    Two words at most two bits apart have one of these in common: that of a word between them.
    Repeats within a row are -1.
    """
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=words.dtype)
    found = np.sort(codeword(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that fingerprints at most four bits apart share a key.

    Of three segments two have at most two differing bits together, as the two best of three
    share at most two thirds of four. For each two segments a key joins the codeword of the one with every
    nearby codeword of the other, both ways round: that meets errors (0,0), (0,1), (1,1), (0,2)
    and their mirror images.
    """
    near, own, shift = [], [], 0
    values = prints.view(np.uint64)
    for bits in SEGMENTS:
        words = (values >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        near.append(nearby(words, bits))
        own.append(codeword(words))
        shift += bits
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for left, right in ((own[i][:, None], near[j]), (near[i], own[j][:, None])):
            key = (pair << 24) + (left.astype(np.int64) << 12) + right
            at, _ = np.nonzero((left >= 0) & (right >= 0))
            rows.append(at)
            keys.append(key[(left >= 0) & (right >= 0)])
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        prints = batch.column("fp").to_numpy()
        rows, keys = segment_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["key", "fp"])


def _near(a: Column | str, b: Column | str) -> Column:
    left, right = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(left.bitwiseXOR(right)) <= MAX_BITS


def star_links(shared: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of fingerprints with those of their bucket's members ``l1`` to ``l4`` that are near them.

    A dense group has the same four in most of its buckets; those rows are one before they are taken apart.
    """
    stars = F.array_distinct(F.array("l1", "l2", "l3", "l4"))
    near = F.filter(stars, lambda x: _near(F.col("fp"), x) & (F.col("fp") != x))
    found = shared.select("fp", near.alias("near")).where(F.size("near") > 0).distinct()
    return found.select(F.col("fp").alias("a"), F.explode("near").alias("b"))


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Component root of every linked fingerprint: ``node``, ``root``; ``distinct`` has ``fp``.

    Two or three fingerprints with one key are compared within the aggregated row. In larger
    buckets every member is first compared with four members of the bucket, which is linear and
    already joins dense groups. What then still holds several components is compared
    exactly: members outside the bucket's largest component against all of other components.
    So every link between two components is found, without emitting all pairs of a dense group.
    """
    keys = stored(distinct.mapInArrow(_keys, "key long, fp long"), "golay")
    mixed = F.xxhash64("fp")
    buckets = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("fp").alias("mix"), F.min("fp").alias("l1"), F.max("fp").alias("l2"),
        F.min_by("fp", mixed).alias("l3"), F.max_by("fp", mixed).alias("l4"),
    ).where("n > 1")
    buckets = stored(buckets, "buckets")
    third = F.col("mix").bitwiseXOR(F.col("l1")).bitwiseXOR(F.col("l2"))  # member of three
    few = buckets.where("n <= 3").select("l1", "l2", F.when(F.col("n") == 3, third).otherwise(F.col("l1")).alias("l5"))
    some = [few.where(_near(a, b) & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
            for a, b in (("l1", "l2"), ("l1", "l5"), ("l2", "l5"))]
    shared = stored(keys.join(buckets.where("n > 3").drop("n", "mix"), "key"), "shared")
    first = star_links(shared)
    first = first.union(some[0]).union(some[1]).union(some[2])
    roots = stored(components(first), "roots")
    members = shared.select("key", "fp").join(roots, F.col("fp") == F.col("node"), "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("comp")
    )
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", F.struct("n", "comp")).alias("main")
    )
    open_rows = stored(members.join(main.where("low <> high"), "key").select("key", "fp", "comp", "main"), "open")
    strays = open_rows.where("comp <> main")
    others = open_rows.select("key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    pairs = strays.join(others, "key").where((F.col("comp") != F.col("comp2")) & _near("fp", "fp2"))
    more = components(pairs.select(F.col("comp").alias("a"), F.col("comp2").alias("b")))
    more = more.select(F.col("node").alias("comp"), F.col("root").alias("top"))
    alone = more.select(F.col("comp").alias("node"), F.col("top").alias("root"))
    inner = roots.join(more, F.col("root") == F.col("comp"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return inner.union(alone.join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``file``, ``place``, ``doc_id``, ``fp``, ``class`` and ``component_id`` of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``component_id`` is the
    smallest id reachable over links of at most four differing bits (null ids are passed over),
    ``class`` the smallest fingerprint, which names the component even where ids are null.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows
    stay; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct")
    roots = linked_fingerprints(distinct.select("fp"))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("class")
    )
    lowest = classes.groupBy("class").agg(F.min("lowest").alias("component_id"))
    named = classes.select("fp", "class").join(lowest, "class").select("fp", "class", "component_id")
    return rows.join(named, "fp").select("file", "place", "doc_id", "fp", "class", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: the smallest id of each component stays.

    Where the smallest id is repeated or null, the row with the smallest file position stays.
    """
    docs = from_files(docs)
    classes = stored(near_duplicates(docs), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "place")
    names = classes.groupBy("class").agg(F.min(order).alias("first"))
    kept = names.select(F.col("first.file").alias("file"), F.col("first.place").alias("place"))
    rows = keyed(docs)
    return rows.join(kept, ["file", "place"], "left_semi").select("row.*")
