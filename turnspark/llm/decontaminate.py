"""Benchmark passages in documents: latent semantic search, then subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import from_files, keyed, slices, utf8
from turnspark.llm.words import folded_words, parse

BLOCK_ITEMS = 256  # item passages of one search; more are searched block by block, a longer item in a block of its own
TILE = 64  # words of a passage
HOP = 32
RUN = 8  # words of a passage that lead to it where they stand unchanged
COMMON = 0.1  # words in a larger share of the passages are left out of the subsequence, if enough others are there
EXTRA = 32  # latent dimensions beyond one per item
COSINE = 0.35
SUBSEQUENCE = 0.6
VERBATIM = 0.9
ANSWER = 0.5
SEED = 7
BLOCK_KEYS = 1 << 12

LEAK = "file long, place long, doc_id long, item_id long, cosine double, subsequence double, first_word long, last_word long"


@dataclass(frozen=True)
class Items:
    """Benchmark items as numbers of the words that occur in them."""

    ids: list[int]
    vocabulary: np.ndarray  # sorted word hashes
    words: list[np.ndarray]  # places in the vocabulary
    passages: list[np.ndarray]  # the words again, TILE at a time
    owner: np.ndarray  # the item of each passage
    answers: list[np.ndarray]  # the words of each item's last sentence


def _hashes(text: bytes) -> np.ndarray:
    return next(iter(parse(pa.array([text], pa.binary()), fold=True))).word_hash


def read_items(rows: list) -> Items:
    """Items of rows with ``item_id`` and ``text``; rows without a word are left out."""
    texts = [(r["item_id"], r["text"]) for r in rows if r["text"] and folded_words(r["text"].encode())]
    hashes = [_hashes(t.encode()) for _, t in texts]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
    answers = []
    for _, text in texts:
        sentences = [s for s in re.split(r"[.?!\n]+", text) if folded_words(s.encode())]
        answers.append(np.unique(np.searchsorted(vocabulary, _hashes(sentences[-1].encode()))))
    words = [np.searchsorted(vocabulary, h) for h in hashes]
    cuts = [_passages(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(c) for c in cuts])
    return Items([i for i, _ in texts], vocabulary, words, [x for c in cuts for x in c], owner, answers)


def n_passages(words: int) -> int:
    """Passages of an item; a rest of up to half a passage belongs to the last one."""
    return max(1, (words + TILE // 2 - 1) // TILE)


def _passages(words: np.ndarray) -> list[np.ndarray]:
    return np.split(words, [TILE * i for i in range(1, n_passages(len(words)))])


class Terms:
    """Vocabulary places of words, -1 for all others; a small bit table spares most look-ups."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.nonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == hashes[some], at, -1)
        return out


def _documents(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[tuple]:
    """(batch, text of each word, word's number in its text, term of each word) for parts of the input."""
    for batch in slices(batches):
        for part in parse(batch.column("text"), fold=True):
            owner = part.line_text[part.word_line]
            starts = np.searchsorted(part.word_line, np.arange(len(part.line_start)))
            yield batch, owner, np.arange(len(owner)) - starts[part.word_line], terms(part.word_hash)


def _tiles(owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Running number of the passage (TILE words without overlap) of each word."""
    edge = number % TILE == 0
    return np.cumsum(edge) - 1


def _counts(rows: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of passages of the corpus and how many hold each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums, tiles = Terms(vocabulary), np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for _, owner, number, term in _documents(batches, terms):
            tile = _tiles(owner, number)
            if len(tile):
                tiles += int(tile[-1]) + 1
                known = term >= 0
                keys = np.unique(tile[known] * len(vocabulary) + term[known])
                sums[:-1] += np.bincount(keys % len(vocabulary), minlength=len(vocabulary))
        sums[-1] = tiles
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for row in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return int(out[-1]), out[:-1]


def _basis(rows: DataFrame, items: Items, weights: np.ndarray, tiles: int) -> np.ndarray:
    """Orthonormal right singular directions of passages and items, by a randomised range finder.

    A is the TF-IDF matrix of all passages with unit rows, and the items' rows weighted to the
    same total energy, so that the space has room for every item. Each task multiplies its own
    rows, A'(A S) for a random S; the sums are added by Spark and only one vocabulary x
    dimensions matrix, bounded by the block of items, is made orthonormal on the driver.
    """
    size = min(len(items.passages) + EXTRA, len(weights))
    start = np.random.default_rng(SEED).standard_normal((len(weights), size)).astype(np.float32)
    vocabulary = items.vocabulary

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(vocabulary), np.zeros((len(weights), size), dtype=np.float32)
        for _, owner, number, term in _documents(batches, terms):
            tile = _tiles(owner, number)
            known = term >= 0
            keys, times = np.unique(tile[known] * len(weights) + term[known], return_counts=True)
            for low in range(0, len(keys), BLOCK_KEYS):  # small enough for the processor's cache; a passage cut in two counts as two
                _add_product(keys[low : low + BLOCK_KEYS], times[low : low + BLOCK_KEYS], weights, start, total)
        used = np.nonzero(total.any(axis=1))[0]
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[used].reshape(-1)), size).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], names=["term", "row"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros((len(weights), size), dtype=np.float64)
        for batch in group.to_batches():
            values = batch.column("row").flatten().to_numpy().reshape(-1, size)
            np.add.at(total, batch.column("term").to_numpy(), values)
        used = np.nonzero(total.any(axis=1))[0]
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[used].astype(np.float32).reshape(-1)), size)
        return pa.table({"term": pa.array(used), "row": values.cast(pa.list_(pa.float32()))})

    parts = rows.mapInArrow(multiply, "term long, row array<float>").withColumn("slot", F.pmod("term", F.lit(64)))
    product = np.zeros((len(weights), size))
    for row in parts.groupBy("slot").applyInArrow(add, "term long, row array<float>").toLocalIterator():
        product[row["term"]] = row["row"]
    queries = _item_rows(items, weights)
    product += max(1.0, tiles / max(1, len(items.passages))) * queries.T @ (queries @ start)
    basis, _ = np.linalg.qr(product)
    return basis


def _add_product(keys: np.ndarray, times: np.ndarray, weights: np.ndarray, start: np.ndarray, total: np.ndarray) -> None:
    """Add X'(X S) for the passages whose (passage, term) keys are given, in order."""
    tile, term = np.divmod(keys, len(weights))
    value = (times * weights[term]).astype(np.float32)
    begin = np.nonzero(np.r_[True, tile[1:] != tile[:-1]])[0]
    row = np.cumsum(np.r_[False, tile[1:] != tile[:-1]])
    value /= np.sqrt(np.add.reduceat(value * value, begin))[row]
    passed = np.add.reduceat(start[term] * value[:, None], begin, axis=0)
    order = np.argsort(term, kind="stable")
    some = term[order]
    edge = np.nonzero(np.r_[True, some[1:] != some[:-1]])[0]
    total[some[edge]] += np.add.reduceat(passed[row[order]] * value[order][:, None], edge, axis=0)


def _item_rows(items: Items, weights: np.ndarray) -> np.ndarray:
    """A row for each passage of the items."""
    rows = np.stack([np.bincount(w, minlength=len(weights)) * weights for w in items.passages]).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each place of the item."""
    masks: dict[int, int] = {}
    for place, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << place
    full = (1 << len(item)) - 1
    rest = full
    for word in text:
        hit = rest & masks.get(word, 0)
        rest = (rest + hit | rest - hit) & full
    return len(item) - rest.bit_count()


class Runs:
    """Where the heaviest RUN words of each item passage (all words of a shorter one) stand unchanged in a text."""

    def __init__(self, items: Items, weights: np.ndarray):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int]]] = {}
        for passage, words in enumerate(items.passages):
            n = min(RUN, len(words))
            total = np.r_[0.0, np.cumsum(weights[words])]
            start = int(np.argmax(total[n:] - total[:-n]))
            found.setdefault(n, []).append((int(_run_keys(words[start : start + n], n)[0]), passage))
        for n, pairs in found.items():
            pairs.sort()
            self.by_length[n] = np.array([k for k, _ in pairs], dtype=np.uint64), np.array([p for _, p in pairs])

    def __call__(self, owner: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(passage, first word, end) of each place; equal keys of other words only add candidates."""
        for n, (keys, passages) in self.by_length.items():
            if len(term) < n:
                continue
            unknown = np.r_[0, np.cumsum(term < 0)]
            start = np.nonzero((unknown[n:] == unknown[:-n]) & (owner[n - 1 :] == owner[: len(owner) - n + 1]))[0]
            if not len(start):
                continue
            here = _run_keys(term, n)[start]
            low, high = (np.searchsorted(keys, here, side=side) for side in ("left", "right"))
            for i in np.nonzero(high > low)[0].tolist():
                for passage in passages[low[i] : high[i]].tolist():
                    yield passage, int(start[i]), int(start[i]) + n


def _run_keys(term: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n words."""
    out = np.zeros(len(term) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + term[i : i + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def _search(items: Items, weights: np.ndarray, common: np.ndarray, latent: np.ndarray, cosine: float):
    """Task function: leaks of each document among the passages whose latent cosine is high enough or that hold a run."""
    size = len(weights)
    best = np.maximum(latent.max(axis=1), 0)
    first = np.searchsorted(items.owner, np.arange(len(items.ids)))  # passage of each item
    content = [[int(w) for w in words if not common[w]] for words in items.words]
    content = [c if len(c) >= 4 else [int(w) for w in words] for c, words in zip(content, items.words)]

    def windows(owner: np.ndarray, number: np.ndarray, value: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the passages that may reach the cosine: by the Cauchy bound on the words' shares."""
        last = np.r_[owner[1:] != owner[:-1], True]
        stop = np.nonzero(last)[0][np.cumsum(np.r_[False, last[:-1]])] + 1  # end of each word's text
        begin = np.nonzero(number % HOP == 0)[0]
        begin = begin[(number[begin] == 0) | (stop[begin] - begin > HOP)]  # else the one before reaches the end
        end = np.minimum(begin + TILE, stop[begin])
        dot, norm = (np.r_[0.0, np.cumsum(x)] for x in (gain, value * value))
        high = dot[end] - dot[begin] >= cosine * np.sqrt(np.maximum(norm[end] - norm[begin], 0)) - 1e-9
        high &= norm[end] - norm[begin] > 1e-12
        return begin[high], end[high]

    def scored(term: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, item, cosine) where the latent cosine is high enough; windows are ranges of ``term``."""
        count = high - low
        window = np.repeat(np.arange(len(low)), count)
        place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + low[window]
        keys, times = np.unique(window * size + term[place], return_counts=True)
        window, some = np.divmod(keys, size)
        value = (times * weights[some]).astype(np.float32)
        edge = np.nonzero(np.r_[True, window[1:] != window[:-1]])[0]
        norm = np.sqrt(np.add.reduceat(value * value, edge))
        scores = np.add.reduceat(latent[some] * value[:, None], edge, axis=0) / norm[:, None]
        if len(first) < scores.shape[1]:
            scores = np.maximum.reduceat(scores, first, axis=1)
        hit, item = np.nonzero(scores >= cosine)
        return list(zip(window[edge][hit].tolist(), item.tolist(), scores[hit, item].tolist()))

    def cosine_at(term: np.ndarray, passage: int) -> float:
        """Latent cosine of one passage of a text."""
        some, times = np.unique(term[term >= 0], return_counts=True)
        value = times * weights[some]
        return float(latent[some, passage] @ value / np.linalg.norm(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(items.vocabulary)
        runs = Runs(items, weights)
        table = np.append(weights, 0.0)
        top = np.append(best * weights, 0.0)
        for batch, owner, number, term in _documents(batches, terms):
            if not len(owner):
                continue
            begin, end = windows(owner, number, table[term], top[term])
            found: dict[tuple[int, int], tuple] = {}
            used = np.nonzero(table[term] > 0)[0]
            lows, highs = np.searchsorted(used, begin), np.searchsorted(used, end)
            for block in range(0, len(begin), 512):
                at = slice(block, block + 512)
                for window, item, score in scored(term[used], lows[at], highs[at]):
                    place = block + window
                    check(found, item, score, int(begin[place]), int(end[place]), owner, number, term)
            latent_hits = set(found)
            for passage, low, high in runs(owner, term):
                item = int(items.owner[passage])
                if (int(owner[low]), item) not in latent_hits:
                    stop = low + int(np.searchsorted(owner[low : low + TILE], owner[low], side="right"))
                    check(found, item, cosine_at(term[low:stop], passage), low, high, owner, number, term)
            if found:
                rows = list(found.items())
                arrays = [batch.column(c).take(pa.array([k[0] for k, _ in rows], pa.int64())) for c in ("file", "place", "doc_id")]
                arrays.append(pa.array([items.ids[k[1]] for k, _ in rows], pa.int64()))
                arrays += [pa.array([v[i] for _, v in rows], pa.float64()) for i in (1, 0)]
                arrays += [pa.array([v[i] for _, v in rows], pa.int64()) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in LEAK.split(", ")])

    def check(found: dict, item: int, score: float, low: int, high: int, owner: np.ndarray, number: np.ndarray, term: np.ndarray) -> None:
        reach = len(items.words[item])
        begin, end = max(0, low - reach), min(len(owner), high + reach)
        begin += int(np.searchsorted(owner[begin:low], owner[low]))
        end = high + int(np.searchsorted(owner[high:end], owner[low], side="right"))
        wanted = content[item]
        place = np.nonzero(np.isin(term[begin:end], wanted))[0] + begin
        text = term[place].tolist()
        share = subsequence(wanted, text) / len(wanted)
        if share < SUBSEQUENCE:
            return
        answer = items.answers[item]
        if share < VERBATIM and np.isin(answer, term[begin:end]).mean() < ANSWER:
            return
        key = (int(owner[low]), item)
        value = (share, score, int(number[place[0]]), int(number[place[-1]]))
        if key not in found or found[key][:2] < value[:2]:
            found[key] = value

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each document and benchmark item that it holds.

    ``file``, ``place`` (see ``keyed``), ``doc_id``, ``item_id``, ``cosine`` (in the latent space),
    ``subsequence`` (share of the item's content words that stand in order in the document),
    ``first_word`` and ``last_word`` (places of the item's words nearby). Words are runs of digits,
    letters and characters beyond ASCII of the lower-cased text. Null and empty texts hold nothing, items
    without a word are in no document, repeated rows and items are all reported. All passages of
    all documents are searched: those of a high latent cosine with a passage of an item, and those that
    hold a run of RUN words of it unchanged, however common its words are. The benchmark is taken
    in blocks of BLOCK_ITEMS passages, so what the driver and a task hold of it is bounded, but for an item
    that is longer by itself.
    """
    spark = docs.sparkSession
    rows = keyed(docs).select("file", "place", F.col("row.doc_id").cast("bigint").alias("doc_id"), utf8(F.lower(F.col("row.text").cast("string"))).alias("text"))
    out = spark.createDataFrame([], LEAK)
    block: list = []
    held = 0  # passages of the block
    given = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    for row in [*given.orderBy("item_id", "text").toLocalIterator(), None]:
        more = n_passages(len(folded_words((row["text"] or "").encode()))) if row is not None else 0
        if block and (row is None or held + more > BLOCK_ITEMS):
            items = read_items(block)
            block, held = [], 0
            if items.ids:
                out = out.union(_block_leaks(rows, items, cosine))
        if row is not None:
            block.append(row)
            held += more
    return out


def _weights(counts: np.ndarray, tiles: int) -> np.ndarray:
    """Smoothed inverse frequency, from log 2 on for a word of all passages."""
    return np.log1p((tiles + 1) / (counts + 1))


def _block_leaks(rows: DataFrame, items: Items, cosine: float) -> DataFrame:
    text = rows.select("text")
    tiles, counts = _counts(text, items.vocabulary)
    weights = _weights(counts, tiles)
    basis = _basis(text, items, weights, tiles)
    queries = _item_rows(items, weights)
    seen = queries @ basis
    seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)
    latent = (basis @ seen.T).astype(np.float32)
    return rows.mapInArrow(_search(items, weights, counts > max(1, COMMON * tiles), latent, cosine), LEAK)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    docs = from_files(docs)
    found = leaks(docs, benchmark, cosine).select("file", "place").distinct()
    return keyed(docs).join(found, ["file", "place"], "left_anti").select("row.*")
