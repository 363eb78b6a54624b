"""Learned decision lists over text statistics, from counting words to verdict in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import stored

WINDOW = 5
CUTS = 48  # candidate thresholds of a statistic
MAX_RULES = 12
MAX_CONDITIONS = 4
PRECISION = 0.9  # least share of low quality among what a rule covers in the pruning part
SUPPORT = 5  # labelled rows that a rule must cover there
BLANK = r"[ \t-\r]"
STATISTICS = ["n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(windows: Column) -> Column:
    """Words covered by the windows (hashes in text order) that occur more than once."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def same(p: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))

    twice = let(pairs, lambda p: F.filter(p, lambda x, i: same(p, x, i - 1) | same(p, x, i + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        places, start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _windows(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    ))


def _word_statistics(words: Column) -> Column:
    repeat = F.when(F.size(words) < WINDOW, 0).otherwise(let(
        _windows(words), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_repeated(w))
    ))
    return F.struct(
        F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), repeat.alias("n_repeat_words")
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of each row.

    Words are runs outside blank, tab, feeds and return; null texts have none. Windows are
    compared by 64-bit hashes. Whole texts count, and nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    one = docs.select(
        "doc_id", let(words, _word_statistics).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    return one.select("doc_id", *[
        F.col(c).cast("bigint").alias(c.split(".")[-1]) for c in ("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    ])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates(stats: DataFrame) -> DataFrame:
    """Adds the statistics that rules may use, as doubles; rates are by word and zero without words."""
    per = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return stats.withColumns({
        "word_length": per("word_chars"), "symbol_rate": per("n_symbols"),
        "dup_line_rate": per("n_dup_lines"), "repeat_rate": per("n_repeat_words"),
    })


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.statistic).cast("double")
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(Column.__and__, [c.column() for c in rule], F.lit(True))


def decision(rules: list[Rule]) -> Column:
    """Ordered conditional expression: number of the first rule that covers the row, else null."""
    out = F.lit(None).cast("int")
    for number in range(len(rules) - 1, -1, -1):
        out = F.when(covers(rules[number]), number).otherwise(out)
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> Condition | None:
    """The condition of largest gain on the rows that the rule so far covers, from one count by statistic and bin."""
    bins = F.array(*[
        F.struct(F.lit(s).alias("s"), reduce(Column.__add__, [(F.col(s) > c).cast("int") for c in cuts[s]], F.lit(0)).alias("b"))
        for s in STATISTICS
    ])
    counted = rows.select(F.explode(bins).alias("x"), "bad").groupBy("x.s", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    table = {(r["s"], r["b"]): (r["p"], r["n"]) for r in counted.collect()}  # at most statistics x cuts rows
    before, best, gain = log2(bad / (bad + good)), None, 1e-9
    for s in STATISTICS:
        p = n = 0
        for k, cut in enumerate(cuts[s]):
            one = table.get((s, k), (0, 0))
            p, n = p + one[0], n + one[1]
            for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                value = x * (log2(x / (x + y)) - before) if x else 0.0
                if value > gain:
                    best, gain = Condition(s, above, cut), value
    return best


def _counts(rows: DataFrame, rule: Rule = ()) -> tuple[int, int]:
    row = rows.where(covers(rule)).agg(F.sum("bad"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1] - (row[0] or 0)


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for low quality from rows with the statistics and ``quality`` (0 or 1).

    Sequential covering: two thirds of the rows (by a hash of the id) grow a conjunction by the condition
    of largest gain, the others prune it to the prefix of best precision. A rule
    is kept if it reaches PRECISION there; what it covers then leaves both parts. All labelled
    rows count; the driver sees bin counts only.
    """
    rows = labelled.where("quality is not null").withColumn("bad", (F.col("quality") == 0).cast("int"))
    rows = stored(rows.withColumn("grow", F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0), "labelled")
    steps = [F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)]
    found = rows.agg(*[F.percentile_approx(F.col(s).cast("double"), F.array(*steps), F.lit(10000)).alias(s) for s in STATISTICS]).first()
    if found is None or found[0] is None:
        return []
    cuts = {s: sorted(set(found[s])) for s in STATISTICS}
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rest = rows.where(decision(rules).isNull())
        grow, prune = rest.where("grow"), rest.where("not grow")
        rule: Rule = ()
        bad, good = _counts(grow)
        while bad and good and len(rule) < MAX_CONDITIONS:
            condition = _best(grow.where(covers(rule)), cuts, bad, good)
            if condition is None:
                break
            rule = (*rule, condition)
            bad, good = _counts(grow, rule)
        best, score = None, PRECISION
        for size in range(1, len(rule) + 1):
            p, n = _counts(prune, rule[:size])
            if p + n >= SUPPORT and p / (p + n) >= score and (best is None or p / (p + n) > score):
                best, score = rule[:size], p / (p + n)
        if best is None:
            break
        rules.append(best)
    return rules


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``rule`` (number of the rule that rejects) of every row of ``docs``.

    Rows that fail the base rule are no examples, as the list never decides on them. Repeated
    rows get equal results; without labels of both kinds there are no rules.
    """
    stats = stored(rates(statistics(docs)).withColumn("base_failed", base_failed()), "statistics")
    given = stats.where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    rules = learn(given)
    rule = F.when(F.col("base_failed"), F.lit(None).cast("int")).otherwise(decision(rules))
    return stats.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
