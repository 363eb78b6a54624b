"""Language identification with unigram pieces, summed over every segmentation of a word."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnspark.llm.tables import remember, return_free_memory, slices, stored

UNKNOWN = "und"
#: Fitting bound: this many labelled texts per language are expected, drawn by a hash of the id.
SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 3
LONG = 64  # runs beyond this many characters are summed one by one, position after position
STRETCH = 4096  # positions of a long run whose pieces are looked up at once
SMOOTH = 0.5
SCALE = 24.0  # per-character factor that keeps forward sums near one
KEPT = 0.1  # rows go where strangers are nine times as likely; short clean texts may score below a half
CACHE_CHARS = 4_000_000  # characters of the words a worker keeps scores of
START = "▁"
WORD = re.compile(r"[^\W\d_]+")


def public_pieces(path: str) -> list[str]:
    """All pieces of the public vocabulary that consist of letters, perhaps after a word start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p.lower() for p in pieces if p.lower().removeprefix(START).isalpha()})


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs, marked at the start."""
    runs = WORD.findall(text.lower())
    if not all(run.isalpha() for run in runs):  # signs such as fractions and powers are no letters
        runs = "".join(c if c.isalpha() else " " for run in runs for c in f"{run} ").split()
    return [START + run for run in runs]


class Lattice:
    """Piece ids of all substrings of many words at once, and sums over their segmentations.

    Characters outside the vocabulary are pieces of their own with the id ``unknown``.
    """

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.unknown = self.size
        self.longest = max(map(len, pieces), default=1)
        self.tables = []
        for n in range(1, self.longest + 1):
            some = [(self._code(p)[0], i) for i, p in enumerate(pieces) if len(p) == n]
            some.sort(key=lambda x: [int(c) for c in x[0]])
            keys = self._keys(np.array([c for c, _ in some], dtype=np.uint64).reshape(-1, n), n)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array([i for _, i in some], dtype=np.int64)[order]))

    @staticmethod
    def _code(word: str) -> tuple[np.ndarray, int]:
        return np.frombuffer(word.encode("utf-32-le"), dtype="<u4"), len(word)

    @staticmethod
    def _keys(codes: np.ndarray, n: int) -> np.ndarray:
        key = np.zeros(len(codes), dtype=np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[:, i] + np.uint64(1)
            key ^= key >> np.uint64(29)
        return key

    def ids(self, codes: np.ndarray) -> list[list[np.ndarray]]:
        """ids[n - 1][i]: piece of the n characters at i for each word, -1 where there is none."""
        length = codes.shape[1]
        out = []
        for n, (keys, numbers) in enumerate(self.tables, 1):
            row = []
            for i in range(length - n + 1):
                if not len(keys):
                    row.append(np.full(len(codes), -1))
                    continue
                key = self._keys(codes[:, i : i + n], n)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                row.append(np.where(keys[at] == key, numbers[at], -1))
            out.append(row)
        for i in range(length):
            out[0][i] = np.where(out[0][i] < 0, self.unknown, out[0][i])
        return out

    def forward(self, ids: list[list[np.ndarray]], probs: np.ndarray) -> list[np.ndarray]:
        """alpha[e]: (languages, words) summed probability of the first e characters, times SCALE**e.

        ``probs`` is (languages, words or 1, pieces + 2); the last piece, at -1, has probability zero.
        """
        length = len(ids[0])
        alpha = [np.ones((len(probs), len(ids[0][0])))]
        for end in range(1, length + 1):
            total = 0.0
            for n in range(1, min(self.longest, end) + 1):
                total = total + alpha[end - n] * probs[:, ids[n - 1][end - n]] * SCALE**n
            alpha.append(total)
        return alpha

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, character codes) for the words of each length up to LONG, in blocks."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths[lengths <= LONG]):
            places = np.nonzero(lengths == n)[0]
            rows = min(8192, (1 << 17) // int(n))
            for low in range(0, len(places), rows):
                some = places[low : low + rows]
                text = "".join([words[i] for i in some])
                yield some, np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(-1, n).astype(np.uint64)

    def _starting(self, codes: np.ndarray, low: int, high: int) -> np.ndarray:
        """(longest, high - low): piece of n + 1 characters that starts at each place of a long run, or -1."""
        out = np.full((self.longest, high - low), -1)
        for n, (keys, numbers) in enumerate(self.tables, 1):
            part = codes[low : min(high + n - 1, len(codes))]
            if len(keys) and len(part) >= n:
                key = self._keys(np.lib.stride_tricks.sliding_window_view(part, n), n)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                out[n - 1, : len(key)] = np.where(keys[at] == key, numbers[at], -1)
        out[0] = np.where(out[0] < 0, self.unknown, out[0])
        return out

    def run_forward(self, codes: np.ndarray, probs: np.ndarray) -> Iterator[np.ndarray]:
        """log alpha[e] of (languages,) for e = 1, 2, ... of one run of any length.

        Only the sums that pieces still reach into are carried, each time divided by the current one.
        """
        logs = np.zeros(len(probs))
        ahead = np.zeros((self.longest, len(probs)))
        for low in range(0, len(codes), STRETCH):
            high = min(low + STRETCH, len(codes))
            steps = probs[:, self._starting(codes, low, high)].transpose(2, 1, 0)
            for step in steps:
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0.0
                ahead += step
                value = ahead[0].copy()
                ahead /= value
                logs = logs + np.log(value)
                yield logs

    def run_expected(self, word: str, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of one long run under one language."""
        codes = self._code(word)[0].astype(np.uint64)
        n = len(codes)
        alpha = np.zeros(n + 1)
        for e, logs in enumerate(self.run_forward(codes, probs[None]), 1):
            alpha[e] = logs[0]
        counts = np.zeros(self.size + 1)
        after = np.zeros(self.longest)  # beta of the next places over that of the next one
        after[0] = 1.0
        log_beta = 0.0
        for low in range((n - 1) // STRETCH * STRETCH, -1, -STRETCH):
            ids = self._starting(codes, low, min(low + STRETCH, n))
            chances = probs[ids]
            for i in range(ids.shape[1] - 1, -1, -1):
                terms = chances[:, i] * after
                value = terms.sum()
                share = terms * np.exp(alpha[low + i] + log_beta - alpha[n])
                np.add.at(counts, np.maximum(ids[:, i], 0), np.where(ids[:, i] < 0, 0.0, share))
                after[1:] = after[:-1].copy()
                after[0] = value
                after /= value
                log_beta += np.log(value)
        return counts

    def log_scores(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """(words, languages) log probability of each word, all segmentations summed."""
        out = np.zeros((len(words), len(probs)))
        for places, codes in self.by_length(words):
            alpha = self.forward(self.ids(codes), probs)[-1]
            out[places] = (np.log(alpha) - codes.shape[1] * np.log(SCALE)).T
        for i, word in enumerate(words):
            if len(word) > LONG:
                for logs in self.run_forward(self._code(word)[0].astype(np.uint64), probs):
                    out[i] = logs
        return out

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of weighted words under one language, by forward and backward sums."""
        counts = np.zeros(self.size + 1)
        for places, codes in self.by_length(words):
            ids = self.ids(codes)
            length = codes.shape[1]
            alpha = self.forward(ids, probs[None])
            beta = [np.ones(len(places))] * (length + 1)
            for start in range(length - 1, -1, -1):
                total = 0.0
                for n in range(1, min(self.longest, length - start) + 1):
                    total = total + probs[ids[n - 1][start]] * SCALE**n * beta[start + n]
                beta[start] = total
            weight = weights[places] / alpha[-1][0]
            for n in range(1, self.longest + 1):
                for i in range(length - n + 1):
                    piece = ids[n - 1][i]
                    share = alpha[i][0] * probs[piece] * SCALE**n * beta[i + n] * weight
                    counts += np.bincount(np.maximum(piece, 0), np.where(piece < 0, 0, share), self.size + 1)
        for word, weight in zip(words, weights):
            if len(word) > LONG:
                counts += weight * self.run_expected(word, probs)
        return counts


@dataclass(frozen=True)
class LanguageModel:
    """``probs[i]`` holds the piece probabilities of ``languages[i]``, one for unknown characters and a zero."""

    languages: list[str]
    pieces: list[str]
    probs: np.ndarray

    def characters(self) -> tuple[dict[str, int], np.ndarray]:
        """Places of the characters and their log probabilities in each language, in the last place for unknown ones.

        These are the characters of the language's own pieces, drawn one by one: what a text looks
        like that has its letters, but neither its words nor parts of them.
        """
        places: dict[str, int] = {c: i for i, c in enumerate(sorted(set("".join(self.pieces))))}
        lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        piece = np.repeat(np.arange(len(self.pieces)), lengths)
        place = np.array([places[c] for p in self.pieces for c in p], dtype=np.int64)
        counts = np.zeros((len(self.probs), len(places) + 1))
        for row, probs in zip(counts, self.probs):
            row[:-1] = np.bincount(place, probs[piece], len(places))
            row[-1] = probs[len(self.pieces)]
        return places, np.log(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word in words_of(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        langs, words = [k[0] for k in counts], [k[1] for k in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def _smooth(counts: np.ndarray) -> np.ndarray:
    return np.append((counts + SMOOTH) / (counts.sum() + SMOOTH * len(counts)), 0.0)


def fit(rows: DataFrame, pieces: list[str], sample: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities of each language from ``rows`` (``key``, ``text``, ``lang``).

    About ``sample`` texts of each language, picked by a hash of ``key``, are counted as whole
    texts; expectation maximisation then runs on the distinct words as Spark jobs, and the
    driver only gets one number per language and piece. Rows without text or lang are not used.
    """
    given = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    lattice = Lattice(pieces)
    if not languages:
        return LanguageModel([], pieces, np.zeros((0, lattice.size + 2)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = given.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    start = np.append(np.ones(lattice.size + 1) / (lattice.size + 1), 0.0)
    probs = np.tile(start, (len(languages), 1))
    for _ in range(rounds):
        current = probs

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Lattice(pieces)
            for batch in slices(batches, 1 << 15):
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                texts = np.array(batch.column("word").to_pylist(), dtype=object)
                weights = batch.column("n").to_numpy().astype(float)
                for i, lang in enumerate(languages):
                    mine = np.nonzero(langs == lang)[0]
                    if len(mine):
                        counts = own.expected(list(texts[mine]), weights[mine], current[i])
                        used = np.nonzero(counts)[0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(used), i)), pa.array(used), pa.array(counts[used])], names=["lang", "piece", "n"]
                        )

        sums = words.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(languages), lattice.size + 1))
        for row in sums.collect():  # at most languages x pieces of the fixed vocabulary
            counts[row["lang"], row["piece"]] = row["n"]
        probs = np.array([_smooth(c) for c in counts])
    return LanguageModel(languages, pieces, probs)


class _Scorer:
    """Word scores of one worker, kept from batch to batch up to CACHE_CHARS characters."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.letters, self.letter_logs = model.characters()
        even = np.append(np.full(self.lattice.size + 1, 1.0 / (self.lattice.size + 1)), 0.0)
        self.probs = np.concatenate([model.probs, even[None]])
        self.places: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, 2 * len(model.languages) + 1))

    def _fresh(self, words: list[str]) -> np.ndarray:
        """(words, 2 x languages + 1): log probability by pieces, by equally likely pieces, by characters one by one."""
        get, unknown = self.letters.get, len(self.letters)
        text = "".join(words)
        places = np.fromiter((get(c, unknown) for c in text), dtype=np.int64, count=len(text))
        ends = np.cumsum([len(w) for w in words])
        plain = np.stack([np.add.reduceat(logs[places], np.append(0, ends[:-1])) for logs in self.letter_logs], axis=1)
        return np.concatenate([self.lattice.log_scores(words, self.probs), plain], axis=1)

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t or "") for t in texts]
        if self.chars > CACHE_CHARS:
            self.places, self.scores, self.chars = {}, self.scores[:0], 0
        known = len(self.places)
        places = self.places
        flat = np.fromiter((places.setdefault(w, len(places)) for some in words for w in some), dtype=np.int64)
        if len(places) > known:
            fresh = _tail(places, known)
            self.chars += sum(map(len, fresh))
            if self.model.languages:
                self.scores = np.concatenate([self.scores, self._fresh(fresh)])
        names, best, many = [], np.zeros(len(texts)), len(self.model.languages)
        low = 0
        for i, some in enumerate(words):
            high = low + len(some)
            if high == low or not self.model.languages:
                names.append(UNKNOWN)
            else:
                total, even, plain = np.split(self.scores[flat[low:high]].sum(axis=0), [many, many + 1])
                likeliest = int(total.argmax())
                share = 1.0 / np.exp(total - total[likeliest]).sum()
                names.append(self.model.languages[likeliest])
                gain = (total[likeliest] - max(plain[likeliest], even[0])) / (high - low)
                best[i] = share / (1.0 + np.exp(-max(gain, -500.0)))
            low = high
        return names, best


#: The model a reused Python worker has last scored with, so that tasks share its word scores.
_SCORERS: dict[str, _Scorer] = {}


def _tail(places: dict[str, int], known: int) -> list[str]:
    out = []
    for word in reversed(places):
        if places[word] < known:
            break
        out.append(word)
    return out[::-1]


def predictor(model: LanguageModel):
    """Column function text -> struct(lang_pred, score): the likeliest language and how sure it is.

    The score is the language's share among all, times its share, for the text's average word,
    against the likelier of two strangers: the language's characters drawn one by one (letters
    without words) and all pieces drawn alike (scripts and words it has not seen). So texts that resemble no learned
    language score low whichever of them is nearest. Null texts and texts without a letter get ``und`` and score zero.
    """
    name = uuid.uuid4().hex

    @pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remember("langid", _SCORERS.clear)
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = _Scorer(model)
        for part in parts:
            names, best = [], []
            for low in range(0, len(part), 256):
                some = [t if isinstance(t, str) else None for t in part.iloc[low : low + 256]]
                found = _SCORERS[name].texts(some)
                names += found[0]
                best.append(found[1])
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(best) if best else np.zeros(0)})
        part = None
        return_free_memory()

    return predict


def held_out(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the id's text is divisible by five; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_documents(docs: DataFrame, vocabulary: str, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Model from ``text`` and ``lang`` of the documents that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    return fit(rows, public_pieces(vocabulary), sample)


def identify(docs: DataFrame, vocabulary: str, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; other columns are never read.

    Repeated rows get equal results, an empty table an empty one; without any labelled text
    every prediction is ``und``.
    """
    predict = predictor(fit_documents(docs, vocabulary, sample))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = KEPT, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Rows of ``docs`` whose language is found with a score of at least ``least``; all columns stay."""
    predict = predictor(fit_documents(docs, vocabulary, sample))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("found", predict(F.col("row.text").cast("string")))
    return rows.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
