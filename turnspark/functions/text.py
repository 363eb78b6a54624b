"""Text columns. Everything stays in JVM expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnspark.functions.binding import bind

# ---- fixed values -------------------------------------------------------
# Characters Python counts as whitespace; Java's \\s and trim() know fewer.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CURLY_QUOTES = "‘’“”"
STRAIGHT_QUOTES = "''\"\""
TRAILING_WORDS = (
    "a about actually also an and are as at because but by for from if in is like of on or so "
    "than that the then to uh um wait well when while with"
).split()
REQUEST_PREFIXES = (
    "can you",
    "could you",
    "would you",
    "please",
    "what is",
    "what are",
    "how do",
    "how can",
    "tell me",
    "show me",
    "i need",
    "i want",
)
FILLERS = "um uh erm hmm wait actually".split()
CONJUNCTIONS = "and or but because so".split()
CUE_TOKEN = "[a-z0-9']+"
WORD_TOKEN = "[\\p{L}\\p{N}_]{2,}"
ENDPOINT_NAMES = [
    "log_chars",
    "log_words",
    "log_commas",
    "log_stops",
    "ends_period",
    "ends_question",
    "ends_exclamation",
    "ends_comma",
    "ends_dash",
    "last_word_trailing",
    "starts_request",
    "has_question",
    "has_comma",
    "fillers",
    "conjunctions",
    "few_words",
    "few_chars",
    "long_words",
]
# -------------------------------------------------------------------------


def clean_text(text: Column) -> Column:
    """Null becomes empty; all leading and trailing whitespace goes."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def plain_blanks(text: Column) -> Column:
    """Every kind of whitespace becomes a blank."""
    return F.translate(text, WHITESPACE, " " * len(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """Canonical form for duplicate search: case, quotes and blanks no longer matter."""
    value = clean_text(F.lower(text))
    value = F.translate(
        value, WHITESPACE + CURLY_QUOTES, " " * len(WHITESPACE) + STRAIGHT_QUOTES
    )
    value = F.regexp_replace(value, " {2,}", " ")
    return F.regexp_replace(value, " ([,.!?;:])", "$1")


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _count_of(text: Column, characters: str) -> Column:
    """Occurrences of any of the characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _tokens(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"({CUE_TOKEN})"), F.lit(1))


def _word_counts(lowered: Column) -> Column:
    """Struct of the word count, the last word and the listed-word counts, tokenised once."""

    def listed(tokens: Column, options: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(options))).cast("double")

    def summary(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).alias("words"),
            F.coalesce(F.get(tokens, F.size(tokens) - 1), F.lit("")).alias("last"),
            listed(tokens, FILLERS).alias("fillers"),
            listed(tokens, CONJUNCTIONS).alias("conjunctions"),
        )

    return bind(_tokens(lowered), summary)


def endpoint_features(text: Column) -> list[Column]:
    """The 18 cue columns, named as in ENDPOINT_NAMES."""
    body = clean_text(text)
    lowered = F.lower(body)
    counts = _word_counts(lowered)
    chars, words = F.length(body), counts["words"]
    starts = F.lit(False)
    for prefix in REQUEST_PREFIXES:
        starts = starts | lowered.startswith(prefix)
    commas = _count_of(body, ",")
    values = [
        F.log1p(chars),
        F.log1p(words),
        F.log1p(commas),
        F.log1p(_count_of(body, ".?!;:")),
        _flag(body.endswith(".")),
        _flag(body.endswith("?")),
        _flag(body.endswith("!")),
        _flag(body.endswith(",")),
        _flag(body.endswith("-") | body.endswith("...")),
        _flag(counts["last"].isin(TRAILING_WORDS)),
        _flag(starts),
        _flag(body.contains("?")),
        _flag(commas > 0),
        counts["fillers"],
        counts["conjunctions"],
        _flag(words <= 4),
        _flag(chars <= 24),
        _flag((words > 0) & (chars / F.greatest(words, F.lit(1)) > 6.5)),
    ]
    return [v.alias(n) for v, n in zip(values, ENDPOINT_NAMES)]


def _runs(items: Column, size: int) -> Column:
    """Every run of ``size`` neighbouring words, blank-joined; none when there are too few."""
    last = F.size(items) - size + 1
    empty = F.array().cast("array<string>")

    def run(i: Column) -> Column:
        return F.array_join(F.slice(items, i, size), " ")

    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), run)).otherwise(empty)


@dataclass(frozen=True)
class Cut:
    """How an array of n-grams comes from words, for steps that count them without making the array."""

    unit: str
    tokens: Column
    low: int
    high: int


def _remember(grams: Column, cut: Cut) -> Column:
    vars(grams)["_cut"] = cut
    return grams


def cut_of(grams: Column) -> Cut | None:
    """The cut of a column of :func:`word_ngrams` or :func:`char_wb_ngrams`."""
    return vars(grams).get("_cut")


def word_ngrams(text: Column, low: int, high: int) -> Column:
    """Array (with repeats) of blank-joined word n-grams of ``low``..``high`` words."""
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD_TOKEN})"), F.lit(1)
    )
    grams = bind(
        tokens,
        lambda words: F.concat(
            *[words if n == 1 else _runs(words, n) for n in range(low, high + 1)]
        ),
    )
    return _remember(grams, Cut("word", tokens, low, high))


def _cuts(word: Column, size: int) -> Column:
    """Every substring of ``size`` characters, at least one."""
    last = F.greatest(F.length(word) - size + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: word.substr(i, F.lit(size)))


def char_wb_ngrams(text: Column, low: int, high: int, lowercase: bool = True) -> Column:
    """Array (with repeats) of character n-grams that stay inside blank-padded words.

    A padded word no longer than n yields itself once, at the smallest such n.
    """
    source = F.coalesce(text, F.lit(""))
    source = F.lower(source) if lowercase else source
    words = F.filter(F.split(plain_blanks(source), " +"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    empty = F.array().cast("array<string>")

    def grams(word: Column) -> Column:
        parts = [_cuts(word, low)]
        for n in range(low + 1, high + 1):
            parts.append(F.when(F.length(word) >= n, _cuts(word, n)).otherwise(empty))
        return F.concat(*parts)

    return _remember(F.flatten(F.transform(padded, grams)), Cut("char", words, low, high))
