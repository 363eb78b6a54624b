"""Cross-validation of many text configurations from one table of n-gram counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.functions.text import ENDPOINT_NAMES, char_wb_ngrams, clean_text, cut_of, endpoint_features, word_ngrams
from turnspark.lineage import cut_lineage, stored
from turnspark.models.row_space import POSTINGS, RowSpace, View, columns, in_span, postings
from turnspark.models.sparse_linear import ROUNDS, Blocks, Fit, fit_many, with_scales
from turnspark.operators import ensemble as en
from turnspark.operators import metrics as m
from turnspark.operators import thresholds as th
from turnspark.operators.bounded import lookup
from turnspark.operators.splits import stratified_kfold
from turnspark.ranking import hash_int, hash_rank, position_rows
from turnspark.skew import lookup_join, spread_rows, spread_texts, text_partitions

MIN_ROWS = 2  # training rows that a term occurs in at least
SWEEP_TOLERANCE = 1e-3  # of the gradients of a sweep; ten times closer than common solvers stop at
WORD_SPAN = (1, 3)  # the n-grams that are counted; configurations use parts of them
CHAR_SPAN = (3, 6)


@dataclass(frozen=True)
class Config:
    """A configuration as data: spans of word and character n-grams (None: not used), cues, loss, C, balance."""

    name: str
    word: tuple[int, int] | None = None
    char: tuple[int, int] | None = None
    cues: bool = False
    loss: str = "hinge"
    trust: float = 1.0
    weights: bool = False  # balanced class weights
    copies: bool = False  # minority rows drawn again up to the majority

    @property
    def kind(self) -> str:
        return "+".join(u for u, used in (("word", self.word), ("char", self.char), ("cues", self.cues)) if used)


SINGLE = (
    Config("word(1,2) + SVC C=1", (1, 2)),
    Config("word(1,2) + SVC C=2", (1, 2), trust=2.0),
    Config("word(1,3) + SVC C=1", (1, 3)),
    Config("word(1,2) + SVC C=1 bal", (1, 2), weights=True),
    Config("word(1,2) + SVC C=1 oversmp", (1, 2), copies=True),
    Config("char(3,5) + SVC C=1", char=(3, 5)),
    Config("char(3,5) + SVC C=2", char=(3, 5), trust=2.0),
    Config("char(4,6) + SVC C=1", char=(4, 6)),
    Config("char(3,5) + SVC C=1 bal", char=(3, 5), weights=True),
    Config("word(1,2) + LR C=1", (1, 2), loss="logistic"),
    Config("word(1,2) + LR C=2 bal", (1, 2), loss="logistic", trust=2.0, weights=True),
    Config("char(3,5) + LR C=2", char=(3, 5), loss="logistic", trust=2.0),
)
UNION = (
    Config("word_char_endpoint_svc_c0.5", (1, 3), (3, 6), True, trust=0.5),
    Config("word_char_endpoint_svc_c1.0", (1, 3), (3, 6), True),
    Config("word_char_endpoint_svc_c0.5_balanced", (1, 3), (3, 6), True, trust=0.5, weights=True),
    Config("word_char_endpoint_svc_c0.5_random_os", (1, 3), (3, 6), True, trust=0.5, copies=True),
    Config("word_only_svc_c0.5", (1, 3), trust=0.5),
    Config("char_endpoint_svc_c0.5", None, (3, 6), True, trust=0.5),
    Config("word_char_endpoint_lr_c2_balanced", (1, 3), (3, 6), True, "logistic", 2.0, True),
)
ENSEMBLE_WEIGHTS = ((0.3, 0.7), (0.5, 0.5), (0.7, 0.3))  # of the best word and the best character model


def gram_counts(texts: DataFrame, word: tuple[int, int] | None = WORD_SPAN, char: tuple[int, int] | None = CHAR_SPAN) -> DataFrame:
    """(id, unit, term, c): the n-grams of a span of either unit (None: not cut), in one pass over the texts."""
    text = clean_text(F.col("text"))

    def named(unit: str, grams: Column) -> Column:
        return F.transform(grams, lambda t: F.struct(F.lit(unit).alias("unit"), t.alias("term")))

    parts = [F.array().cast("array<struct<unit:string,term:string>>")]
    if word:
        parts.append(named("word", word_ngrams(text, *word)))
    if char:
        parts.append(named("char", char_wb_ngrams(text, *char)))
    cut = spread_texts(texts.select("id", "text"), "id").select("id", F.explode(F.concat(*parts)).alias("g"))
    return cut.groupBy("id", "g.unit", "g.term").agg(F.count(F.lit(1)).alias("c"))


def memberships(turns: DataFrame, folds: int, seed: int) -> DataFrame:
    """(id, label, fold, weights): how often each row counts.

    Entry f of ``weights`` is 1 for the training rows of fold f, entry ``folds`` is 1 for all rows, entry
    ``folds`` + 1 + f is the number of copies in fold f's oversampled training rows.
    """
    placed = cut_lineage(stratified_kfold(turns.select("id", "label"), folds, seed))
    drawn = fold_copies(placed, folds, seed)
    wide = drawn.groupBy("id").agg(*[F.sum(F.when(F.col("of") == f, F.col("n")).otherwise(0)).alias(f"d{f}") for f in range(folds)])
    plain = [(F.col("fold") != f).cast("double") for f in range(folds)] + [F.lit(1.0)]
    copies = [F.coalesce(F.col(f"d{f}"), F.lit(0)).cast("double") for f in range(folds)]
    return cut_lineage(placed.join(wide, "id", "left").select("id", "label", "fold", F.array(*plain, *copies).alias("weights")))


def fold_copies(placed: DataFrame, folds: int, seed: int) -> DataFrame:
    """(of, id, n): how often each row is in the oversampled training rows of fold ``of``, all folds in one go.

    The draws are those of ``random_oversample`` with seed + of + 1: majority rows once, and for each of them a
    minority row that its hash picks by rank.
    """
    train = placed.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("fold") != F.col("of"))
    counts: dict[int, list] = {}
    for r in train.groupBy("of", "label").count().orderBy("of", F.desc("count"), "label").limit(3 * folds).collect():
        counts.setdefault(r["of"], []).append((r["label"], r["count"]))
    if any(len(c) != 2 for c in counts.values()):
        raise ValueError("oversampling needs exactly two classes")
    major = lookup({f: c[0][0] for f, c in counts.items()}, F.col("of"))
    size = lookup({f: c[1][1] for f, c in counts.items()}, F.col("of"))
    own = (F.col("of") + F.lit(seed + 1)).cast("string")
    often = train.where(F.col("label") == major)
    digest = F.md5(F.concat_ws(":", own, F.col("id").cast("string")))
    ranked = hash_rank(train.where(F.col("label") != major).select("of", "id"), digest, F.col("id"), ["of"], "_rank")
    pick = hash_int(F.md5(F.concat_ws(":", own, F.lit("draw"), F.col("id").cast("string"))))
    draws = often.select("of", F.col("id").alias("draw_id"), (F.pmod(pick, size) + 1).alias("_rank"))
    drawn = draws.join(ranked, ["of", "_rank"]).groupBy("of", "id").agg(F.count(F.lit(1)).alias("n"))
    return often.select("of", "id", F.lit(1).cast("bigint").alias("n")).unionByName(drawn)


def fold_vocabulary(counts: DataFrame, members: DataFrame, choices: int) -> DataFrame:
    """(unit, term, size, df): rows that hold the term under each choice of rows, for terms in MIN_ROWS rows or more.

    ``size`` is the n-gram's number of words or characters; a character n-gram that is a whole padded word is -size,
    as it stands for itself at any shortest length from its own on.
    """
    joined = counts.select("id", "unit", "term").join(members.select("id", "weights"), "id")
    found = joined.groupBy("unit", "term").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("weights", j)) for j in range(choices)]).alias("df")
    ).where(F.col("n") >= MIN_ROWS)
    return found.select("unit", "term", _size().alias("size"), "df")


def _size() -> Column:
    """The number of words or characters of ``term``, negative for a character n-gram that is a whole padded word."""
    words = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1
    whole = F.col("term").startswith(" ") & F.col("term").endswith(" ")
    letters = F.when(whole, -F.length("term")).otherwise(F.length("term"))
    return F.when(F.col("unit") == "word", words).otherwise(letters).cast("int")


@dataclass(frozen=True)
class Prepared:
    """Stored rows for all models, their blocks, and the view of each (unit, span, choice of rows)."""

    rows: DataFrame
    blocks: Blocks
    views: dict
    vocabulary: DataFrame
    n_rows: np.ndarray
    n_labels: dict
    folds: int


def prepare(turns: DataFrame, configs: Sequence[Config], folds: int, seed: int, others: DataFrame | None = None) -> Prepared:
    """Count once, number the vocabulary, and store one sparse row for each text.

    Only units that a configuration uses are counted, words no longer than the longest span asks for.
    Rows of ``others`` (id, text) have no label and count nowhere; they can be scored.
    """
    members = memberships(turns, folds, seed)
    choices = 2 * folds + 1
    spans = _spans(configs)
    counts = cut_lineage(gram_counts(turns, *spans))
    vocabulary = position_rows(fold_vocabulary(counts, members, choices), [F.desc("unit"), F.col("term")], "at")
    fixed = vocabulary.select("unit", "term", F.col("at").cast("int").alias("at"))
    if others is not None:
        counts = cut_lineage(counts.union(gram_counts(others, *spans)))
        none = others.select("id", F.lit(None).cast("int").alias("label"), F.lit(-1).alias("fold"),
                             F.array(*[F.lit(0.0)] * choices).alias("weights"))
        members = members.union(none)
        turns = turns.select("id", "text").union(others.select("id", "text"))
    known = vocabulary.select("unit", "size", "df", "at").orderBy("at").toArrow()
    unit = np.array(known.column("unit").to_pylist(), dtype=str)
    size = known.column("size").to_numpy()
    df = known.column("df").combine_chunks().flatten().to_numpy().reshape(-1, choices) if len(unit) else np.zeros((0, choices))
    cues = _cues(turns, members)
    n_rows, n_labels = _sizes(members, choices)
    used = {"word": [], "char": []}
    for c in configs:
        for u, span in (("word", c.word), ("char", c.char)):
            if span and (span, c.copies) not in used[u]:
                used[u].append((span, c.copies))
    bounds, factors, views = {}, {}, {}
    start = 0
    for u in ("word", "char"):
        mine = unit == u
        bounds[u] = (start, start + int(mine.sum()))
        start = bounds[u][1]
        columns = []
        for span, copies in used[u]:
            for choice in range(folds + 1):
                j = choice if not copies or choice == folds else folds + 1 + choice
                idf = np.log((1.0 + n_rows[j]) / (1.0 + df[mine, j])) + 1.0
                views[u, span, copies, choice] = len(columns)
                columns.append(np.where((df[mine, j] >= MIN_ROWS) & in_span(size[mine], span), idf, 0.0))
        factors[u] = np.stack(columns, axis=1) if columns else np.zeros((int(mine.sum()), 1))
    names = list(ENDPOINT_NAMES)
    spread = _spreads(cues, choices, names)
    bounds["cues"] = (start, start + len(names))
    bounds["one"] = (start + len(names), start + len(names) + 1)
    factors["cues"], factors["one"] = spread, np.ones((1, 1))
    sparse = lookup_join(counts, fixed, ["unit", "term"], ["id"]).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("at").alias("i"), (F.lit(1.0) + F.log("c")).alias("x")))).alias("grams")
    )
    extra = F.array(*[F.struct(F.lit(start + i).alias("i"), F.col(n).cast("double").alias("x")) for i, n in enumerate(names)],
                    F.struct(F.lit(start + len(names)).alias("i"), F.lit(1.0).alias("x")))
    empty = F.array().cast("array<struct<i:int,x:double>>")
    rows = cues.join(sparse, "id", "left").select("id", "label", "fold", "weights", F.concat(F.coalesce("grams", empty), extra).alias("e"))
    rows = rows.select("id", "label", "fold", "weights", F.transform("e", lambda e: e["i"]).alias("idx"), F.transform("e", lambda e: e["x"]).alias("val"))
    blocks = Blocks(bounds, factors)
    # an explicit number of partitions, as every pass works on them and they are small
    rows = cut_lineage(with_scales(cut_lineage(spread_rows(rows, "id")), blocks, unscaled=("cues", "one")))
    return Prepared(rows, blocks, views, vocabulary.drop("at"), n_rows, n_labels, folds)


def _spans(configs: Sequence[Config]) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """The spans of word and character n-grams that hold all of the configurations'."""
    words = [c.word for c in configs if c.word]
    return ((min(low for low, _ in words), max(high for _, high in words)) if words else None,
            CHAR_SPAN if any(c.char for c in configs) else None)


def _sizes(members: DataFrame, choices: int) -> tuple[np.ndarray, dict]:
    """Rows, and rows of each label, under each choice."""
    label = members.where("label is not null")
    sums = label.groupBy("label").agg(*[F.sum(F.get("weights", j)).alias(f"n{j}") for j in range(choices)]).collect()
    n_labels = {r["label"]: np.array([r[f"n{j}"] for j in range(choices)]) for r in sums}
    return np.sum(list(n_labels.values()), axis=0), n_labels


@dataclass(frozen=True)
class Sweep:
    """Numbered rows (row, id, label, fold), the models' space on them, and the view of each (unit, span, copies, choice)."""

    rows: DataFrame
    space: RowSpace
    views: dict
    n_rows: np.ndarray
    n_labels: dict
    folds: int


def prepare_sweep(turns: DataFrame, configs: Sequence[Config], folds: int, seed: int) -> Sweep:
    """Cut and count once, number the rows, and store the columns of all terms.

    The driver holds labels, weights, cues and scales of the rows and nothing of the terms.
    """
    members = memberships(turns, folds, seed)
    choices = 2 * folds + 1
    n_rows, n_labels = _sizes(members, choices)
    # rows of repeated ids meet in the joins and count as often as ``members`` has them
    often = turns.groupBy("id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("often"))
    cues = _cues(turns, members)
    spread = _spreads(cues, choices, list(ENDPOINT_NAMES))
    rows = cut_lineage(position_rows(cues.join(often, "id"), [F.col("id")], "row").withColumn("row", F.col("row").cast("int")))
    names = [F.col(n).cast("double").alias(n) for n in ENDPOINT_NAMES]
    known = rows.select("row", F.col("label").cast("int").alias("label"), "often", "weights", F.array(*names).alias("cues")).orderBy("row").toArrow()
    n = known.num_rows
    weights, cue = (known.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("weights", "cues"))
    text, spans = clean_text(F.col("text")), _spans(configs)
    cuts = [cut_of(grams(text, *span)) for grams, span in zip((word_ngrams, char_wb_ngrams), spans) if span]
    parts = text_partitions(turns.select("text"))
    cut = turns.select("id", "text").join(rows.select("id", "row").hint("shuffle_hash"), "id").repartition(parts, "row")
    tokens = cut.select("row", *[c.tokens.alias(f"tokens{k}") for k, c in enumerate(cuts)])
    found = postings(tokens, cuts, parts, MIN_ROWS) if cuts else turns.sparkSession.createDataFrame([], POSTINGS)
    cols = columns(found, weights, known.column("often").to_numpy(), n_rows, MIN_ROWS)
    views = {}
    for c in configs:
        for u, span in (("word", c.word), ("char", c.char)):
            for f in range(folds + 1 if span else 0):
                views[u, span, c.copies, f] = View(u, span, f if not c.copies or f == folds else folds + 1 + f)
    dense = {"cues": (cue, spread**2), "one": (np.ones((n, 1)), np.ones((1, 1)))}
    trained = [v for (*_, f), v in views.items() if f < folds]
    space = RowSpace(cols, dense, known.column("label").to_numpy(), weights, trained)
    return Sweep(rows.select("row", "id", "label", "fold"), space, views, n_rows, n_labels, folds)


def _cues(turns: DataFrame, members: DataFrame) -> DataFrame:
    cut = turns.select("id", *endpoint_features(F.col("text")))
    return cut_lineage(members.join(cut, "id"))


def _spreads(cues: DataFrame, choices: int, names: Sequence[str]) -> np.ndarray:
    """1 / population deviation of each cue (rows) under each choice of training rows (columns); 1 for a constant cue."""
    weight = [F.get("weights", j) for j in range(choices)]
    total = cues.agg(*[F.sum(w).alias(f"w{j}") for j, w in enumerate(weight)],
                     *[F.sum(w * F.col(n)).alias(f"s{j}_{n}") for j, w in enumerate(weight) for n in names]).first()
    mean = {(j, n): total[f"s{j}_{n}"] / total[f"w{j}"] for j in range(choices) for n in names}
    second = cues.agg(*[F.sum(w * (F.col(n) - F.lit(mean[j, n])) ** 2).alias(f"q{j}_{n}") for j, w in enumerate(weight) for n in names]).first()
    var = np.array([[second[f"q{j}_{n}"] / total[f"w{j}"] for j in range(choices)] for n in names])
    return np.where(var > 1e-20, 1.0 / np.sqrt(np.where(var > 1e-20, var, 1.0)), 1.0)


def fit_of(prepared: Prepared | Sweep, config: Config, choice: int) -> Fit:
    """The model of a configuration for held-out fold ``choice``, or for all rows where that is the number of folds."""
    folds = prepared.folds
    views = {u: prepared.views[u, span, config.copies, choice] for u, span in (("word", config.word), ("char", config.char)) if span}
    if not views and not config.cues:
        raise ValueError("a text model needs at least one feature block")
    rows = choice if not config.copies or choice == folds else folds + 1 + choice
    if config.cues:
        views["cues"] = rows
    views["one"] = 0
    classes = (1.0, 1.0)
    if config.weights:
        n = prepared.n_rows[rows]
        classes = tuple(float(n / (2 * prepared.n_labels[c][rows])) for c in (0, 1))
    return Fit(config.name, choice, views, config.loss, config.trust, rows, classes)


@dataclass(frozen=True)
class Solved:
    """Models with what is left of their gradients, and the stored margins of each run of the solver on all rows."""

    fits: tuple[Fit, ...]
    left: np.ndarray
    passes: int
    margins: tuple[tuple[tuple[Fit, ...], DataFrame], ...]

    def gradients(self) -> DataFrame:
        """What is left of each model's gradient, as a share of its length at zero."""
        rows = [(f.name, f.fold, float(x), self.passes) for f, x in zip(self.fits, self.left)]
        return self.margins[0][1].sparkSession.createDataFrame(rows, "model string, fold int, gradient double, passes int")


def cross_validate_all(sweep: Sweep, configs: Sequence[Config], tolerance: float = SWEEP_TOLERANCE) -> Solved:
    """All folds of all configurations, as many in one run of the solver as the driver has room for."""
    fits, left, margins, passes = [], [], [], 0
    for group in sweep.space.groups([fit_of(sweep, c, f) for c in configs for f in range(sweep.folds)]):
        found, gradient, rounds = sweep.space.fit(group, tolerance, ROUNDS)
        margins.append((tuple(group), stored(_with_margins(sweep.rows, found))))
        fits += group
        left.append(gradient)
        passes += rounds
    return Solved(tuple(fits), np.concatenate(left), passes, tuple(margins))


def _with_margins(rows: DataFrame, found: np.ndarray) -> DataFrame:
    """(id, label, fold, scores): the entries of ``found`` (models x rows) that belong to each row."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value[:, batch.column("row").to_numpy()].T
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold")), lists], names=["id", "label", "fold", "scores"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("id", "label", "fold")) + ", scores array<double>")


def split_scores(solved: Solved, digits: int = 7) -> DataFrame:
    """(model, fold, id, label, split, score): every fold's model on its training rows and on its held-out rows."""

    def flat(fits: Sequence[Fit], wide: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f.name).alias("model"), F.lit(f.fold).alias("of")) for f in fits])
        return wide.select("id", "label", F.col("fold").alias("own"), F.explode(F.arrays_zip(each.alias("m"), F.col("scores").alias("s"))).alias("e"))

    return reduce(DataFrame.unionByName, [flat(*m) for m in solved.margins]).select(
        F.col("e.m.model").alias("model"), F.col("e.m.of").alias("fold"), "id", "label",
        F.when(F.col("own") == F.col("e.m.of"), "valid").otherwise("train").alias("split"), F.round("e.s", digits).alias("score"),
    )


def _fold_scores(scored: DataFrame) -> DataFrame:
    at_zero = scored.withColumn("pred", (F.col("score") >= 0).cast("int"))
    return m.fold_summary(m.macro_f1(at_zero, (0, 1), ["name", "fold"]), "macro_f1", by=["name"])


def shared_sweep(
    turns: DataFrame, folds: int, seed: int, single: Sequence[Config] = SINGLE, union: Sequence[Config] = UNION
) -> tuple[DataFrame, DataFrame, Solved]:
    """(leaderboard, split scores, models) of all configurations and of the word + character ensembles.

    ``name, kind, mean_score, std_score, fold_scores, threshold, tuned_macro_f1, place``; folds are scored at 0 and the
    threshold is tuned on all held-out scores. Ensembles join the best word and the best character configuration of ``single``
    by scores that are standardised on each fold's training rows.
    """
    configs = [*single, *union]
    fitted = cross_validate_all(prepare_sweep(turns, configs, folds, seed), configs)
    scores = stored(split_scores(fitted))
    held = scores.where("split = 'valid'").select(F.col("model").alias("name"), "fold", "id", "label", "score")
    kinds = {c.name: c.kind for c in configs}
    board = _fold_scores(held).collect()  # one row a configuration
    order = sorted((r for r in board if r["name"] in {c.name for c in single}), key=lambda r: (-r["mean_score"], r["name"]))
    best = {k: next((r["name"] for r in order if kinds[r["name"]] == k), None) for k in ("word", "char")}
    if all(best.values()):
        labels = turns.select("id", "label")
        for weights in ENSEMBLE_WEIGHTS:
            mixed = en.score_zscore_ensemble(scores, {best["word"]: weights[0], best["char"]: weights[1]})
            name = f"ensemble word*{weights[0]} + char*{weights[1]}"
            kinds[name] = "ensemble"
            held = held.unionByName(mixed.join(labels, "id").select(F.lit(name).alias("name"), "fold", "id", "label", F.col("combined").alias("score")))
    held = cut_lineage(held)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("name"))
    tuned = th.tune_thresholds_by(held, "name").select("name", named.alias("kind"), "threshold", F.col("macro_f1").alias("tuned_macro_f1"))
    return en.leaderboard(_fold_scores(held).join(tuned, "name"), "mean_score"), scores, fitted


def bagged_predict(turns: DataFrame, unlabelled: DataFrame, config: Config, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(predictions, out-of-fold probabilities): the mean probability of the fold models, cut where their own held-out rows say.

    The unlabelled rows are read once for all fold models.
    """
    if config.loss != "logistic":
        raise ValueError("only a logistic model gives probabilities")
    prepared = prepare(turns, [config], folds, seed, unlabelled)
    fitted = fit_many(prepared.rows, prepared.blocks, [fit_of(prepared, config, f) for f in range(folds)], SWEEP_TOLERANCE)
    scored = cut_lineage(fitted.scores(prepared.rows, ["id", "label", "fold"]))
    prob = F.transform("scores", lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s)))
    own = scored.where("label is not null").select("id", "label", "fold", F.round(F.get(prob, F.col("fold")), 7).alias("score"))
    cut = th.tune_threshold_probs(own).select("threshold").scalar()
    mean = F.aggregate(prob, F.lit(0.0), lambda a, x: a + x) / folds
    out = scored.where("label is null").select("id", F.transform(prob, lambda p: F.round(p, 7)).alias("members"), F.round(mean, 7).alias("prob"))
    return out.withColumn("pred", (F.col("prob") >= cut).cast("int")), own
