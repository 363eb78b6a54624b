"""Text classifiers: word, character and cue features feeding Spark ML linear models."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspark.functions.scores import binary_score
from turnspark.functions.text import (
    ENDPOINT_NAMES,
    char_wb_ngrams,
    clean_text,
    endpoint_features,
    word_ngrams,
)
from turnspark.lineage import cut_lineage, stored
from turnspark.operators import tfidf as tf
from turnspark.operators.balance import balanced_weights, random_oversample
from turnspark.operators.splits import stratified_kfold
from turnspark.ranking import position_rows
from turnspark.skew import HOT_KEYS, lookup_join

#: Fits are independent job chains; a few at once fill the cluster while each solver waits for its own small driver steps.
PARALLEL_FITS = 5
FIT_BYTES = 1 << 28  # of the driver that the solvers of fits side by side take, about
SOLVER_NUMBERS = 40  # that a solver of Spark's keeps for a term: ten steps, their gradients, and what tasks send
CUTTERS = {"word": word_ngrams, "char": char_wb_ngrams}
#: A Spark ML vector as Arrow sees it.
VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Grams:
    """A block of n-grams of ``unit`` word or char.

    Terms occur in ``min_rows`` training rows or more; ``most`` keeps only the most frequent terms,
    which is left to the caller. The vocabulary is a table that the rows' terms are joined with.
    """

    unit: str
    shortest: int
    longest: int
    min_rows: int = 2
    most: int | None = None


@dataclass(frozen=True)
class Cues:
    """The block of endpoint cues, scaled by their spread in the training rows."""

    unit: str = "cues"


@dataclass(frozen=True)
class Linear:
    """A linear classifier: ``loss`` hinge or logistic, ``trust`` the weight of the data against the penalty.

    ``even`` names the ways to even out the classes, any of ``weights`` and ``copies``.
    """

    loss: str = "hinge"
    trust: float = 1.0
    even: tuple[str, ...] = ()
    rounds: int = 50


@dataclass(frozen=True)
class TextRecipe:
    """Feature blocks, at most one of each unit, and the classifier on top of them."""

    name: str
    blocks: tuple[Grams | Cues, ...]
    classifier: Linear = Linear()

    def block(self, unit: str) -> Grams | Cues | None:
        return next((b for b in self.blocks if b.unit == unit), None)


@dataclass(frozen=True)
class Vocabulary:
    """Rows (term, idf, place), places from 0 to ``size`` - 1, and the terms that most rows hold.

    A vocabulary of several fits has idf0, idf1, ... instead, null where the fit leaves the term out.
    """

    rows: DataFrame
    size: int
    common: tuple[str, ...]

    @classmethod
    def of(cls, rows: DataFrame) -> Vocabulary:
        least = F.array_min(F.array(*[c for c in rows.columns if c.startswith("idf")]))
        top = rows.orderBy(least, "term").limit(HOT_KEYS).select("term").collect()
        return cls(rows, rows.count(), tuple(r["term"] for r in top))

    def weights(self, counts: DataFrame, first: int) -> DataFrame:
        """(id, place, w or w0, w1, ...) of rows (id, term, c), places counted from ``first``: (1 + ln c) idf, 0 without idf."""
        common = F.array(*[F.lit(t) for t in self.common])
        joined = lookup_join(counts.select("id", "term", "c"), self.rows, ["term"], ["id"], hot=common)
        often = F.lit(1.0) + F.log("c")
        weights = [F.coalesce(often * F.col(c), F.lit(0.0)).alias("w" + c[3:]) for c in self.rows.columns if c.startswith("idf")]
        return joined.select("id", (F.col("place") + first).cast("int").alias("place"), *weights)


@dataclass(frozen=True)
class TextFeatures:
    """Fitted blocks: name -> vocabulary, and the cue scale."""

    recipe: TextRecipe
    blocks: dict[str, Vocabulary]
    cue_scale: list[float] | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the vector column ``features``; other columns stay, ``text`` goes."""
        rows = _numbered(df)
        return self.vectors(rows, _counts(rows, self.recipe)).drop("_row")

    def vectors(self, rows: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
        """``rows`` with ``features`` in place of ``text``; ``counts`` are the n-grams of these rows."""
        bounds, entries = _entries(self.blocks, counts)
        kept = [c for c in rows.columns if c != "text"]
        cues = _cues() if self.cue_scale is not None else F.array()
        out = _with_entries(rows.select(*kept, cues.cast("array<double>").alias("_cues")), entries, ["w"])
        return _assembled(out.withColumnRenamed("w", "_weights"), bounds, self.cue_scale or [])


def _cues() -> Column:
    return F.array(*endpoint_features(F.col("text")))


def _entries(blocks: dict[str, Vocabulary], counts: dict[str, DataFrame]) -> tuple[list[tuple[int, int]], DataFrame | None]:
    """First place and end of each block, and (id, _places, w...): arrays of all places of a row and of their weights."""
    bounds, weighed, size = [], None, 0
    for name, vocabulary in blocks.items():
        part = vocabulary.weights(counts[name], size)
        weighed = part if weighed is None else weighed.unionByName(part)
        bounds.append((size, size := size + vocabulary.size))
    if weighed is None:
        return bounds, None
    weights = [F.collect_list(c).alias(c) for c in weighed.columns if c.startswith("w")]
    return bounds, weighed.groupBy("id").agg(F.collect_list("place").alias("_places"), *weights)


def _with_entries(rows: DataFrame, entries: DataFrame | None, weights: list[str]) -> DataFrame:
    """``rows`` with the arrays of their places and weights, null where they have none."""
    if entries is not None:
        return rows.join(entries.withColumnRenamed("id", "_row"), "_row", "left").select(*rows.columns, "_places", *weights)
    none = F.lit(None).cast("array<double>")
    return rows.select("*", F.lit(None).cast("array<int>").alias("_places"), *[none.alias(c) for c in weights])


def _assembled(df: DataFrame, bounds: list[tuple[int, int]], cue_scale: list[float]) -> DataFrame:
    """``features`` from ``_places`` and ``_weights`` (each block brought to unit length), scaled ``_cues`` and a one.

    Weights of zero are left out. The constant entry lets the penalty act on the intercept too.
    """
    kept = [c for c in df.columns if c not in ("_cues", "_places", "_weights")]
    first = bounds[-1][1] if bounds else 0
    size = first + len(cue_scale) + 1
    scale = np.array(cue_scale)

    def packed(stored: np.ndarray, place: np.ndarray, value: np.ndarray) -> pa.StructArray:
        # As in Spark's assembler, a row is dense where that takes less room.
        dense = 1.5 * (stored + 1.0) >= size
        ends = np.concatenate([[0], np.cumsum(stored)])
        if dense.any():
            values = []
            for i, full in enumerate(dense):
                part = value[ends[i] : ends[i + 1]]
                if full:
                    whole = np.zeros(size)
                    whole[place[ends[i] : ends[i + 1]]] = part
                    part = whole
                values.append(part)
            lengths, value = [len(v) for v in values], np.concatenate(values)
            place = place[np.repeat(~dense, stored)]
        else:
            lengths = stored
        value_ends = np.concatenate([[0], np.cumsum(lengths)])
        place_ends = np.concatenate([[0], np.cumsum(np.where(dense, 0, stored))])
        indices = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(place, pa.int32()), mask=pa.array(dense))
        parts = [
            pa.array(dense.astype(np.int8)),
            pa.array(np.full(len(dense), size, np.int32), mask=dense),
            indices,
            pa.ListArray.from_arrays(pa.array(value_ends, pa.int32()), pa.array(value)),
        ]
        return pa.StructArray.from_arrays(parts, fields=list(VECTOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = batch.num_rows, batch.column("_places")
            counts = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            place = places.flatten().to_numpy(zero_copy_only=False)
            value = batch.column("_weights").flatten().to_numpy(zero_copy_only=False)
            known = value != 0
            place, value, row = place[known], value[known], np.repeat(np.arange(n), counts)[known]
            for start, stop in bounds:
                own = (place >= start) & (place < stop)
                squares = np.bincount(row[own], value[own] ** 2, minlength=n)
                value[own] /= np.sqrt(squares[row[own]])
            cues = batch.column("_cues").flatten().to_numpy(zero_copy_only=False).reshape(n, len(scale)) * scale
            extra = np.concatenate([cues, np.ones((n, 1))], axis=1)
            at, which = np.nonzero(extra)
            row, place = np.concatenate([row, at]), np.concatenate([place, first + which])
            value = np.concatenate([value, extra[at, which]])
            order = np.lexsort((place, row))
            place, value = place[order].astype(np.int32), value[order]
            stored = np.bincount(row, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), packed(stored, place, value)], names=[*kept, "features"]
            )

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("features", VectorUDT())])
    return df.mapInArrow(run, schema)


def vector_profile(df: DataFrame, column: str) -> DataFrame:
    """Replace a vector column by its number of stored entries and sum of squares."""
    place = df.columns.index(column)
    kept = [c for c in df.columns if c != column]
    fields = [T.StructField(c, df.schema[c].dataType) for c in kept]
    schema = T.StructType(
        [*fields, T.StructField("n_stored", T.IntegerType()), T.StructField("squares", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(place).field(3)
            ends = np.concatenate(
                [[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]
            )
            running = np.concatenate(
                [[0.0], np.cumsum(values.flatten().to_numpy(zero_copy_only=False) ** 2)]
            )
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array(np.diff(ends).astype(np.int32)))
            columns.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def _numbered(df: DataFrame) -> DataFrame:
    """The rows, written once, with a number of their own: ids may repeat."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def _grams(block: Grams) -> Column:
    return CUTTERS[block.unit](clean_text(F.col("text")), block.shortest, block.longest)


def _counts(rows: DataFrame, recipe: TextRecipe) -> dict[str, DataFrame]:
    """unit -> rows (id, term, c) of the n-grams of numbered rows."""
    if not recipe.blocks:
        raise ValueError("a text model needs at least one feature block")
    texts = rows.select("_row", "text")
    return {b.unit: tf.term_counts(texts, _grams(b), "_row") for b in recipe.blocks if isinstance(b, Grams)}


def _member_counts(rows: DataFrame, counts: dict[str, DataFrame], members: list[str]) -> dict[str, DataFrame]:
    """Rows (id, term, c) stored with the columns of ``rows`` that say how often the row is in each fit's training rows."""
    often = rows.select(F.col("_row").alias("id"), *members).hint("shuffle_hash")
    return {unit: stored(c.join(often, "id")) for unit, c in counts.items()}


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """(_row, n): how often the oversampled rows hold each row."""
    drawn = random_oversample(rows.select("id", "_row", "label"), seed)
    return drawn.groupBy("_row").agg(F.count(F.lit(1)).alias("n"))


def fit_features(train: DataFrame, recipe: TextRecipe) -> TextFeatures:
    """Vocabulary, document frequencies and cue scale of the training rows only."""
    rows = _numbered(train.withColumn("_n", F.lit(1)))
    return _fitted(rows, _member_counts(rows, _counts(rows, recipe), ["_n"]), recipe)


def _fitted(rows: DataFrame, counts: dict[str, DataFrame], recipe: TextRecipe) -> TextFeatures:
    blocks = _vocabularies(rows, counts, recipe, {"_n": "idf"})
    scale = None
    if recipe.block("cues"):
        scale = _cue_scale(rows.select("_n", _cues().alias("_cues")), "_n")
    return TextFeatures(recipe, blocks, scale)


def _vocabularies(
    rows: DataFrame, counts: dict[str, DataFrame], recipe: TextRecipe, members: dict[str, str]
) -> dict[str, Vocabulary]:
    """unit -> vocabulary of several fits on one pass over the n-grams.

    ``members`` names for each fit the column that says how often a row is in its training rows, and its idf's column.
    """
    blocks = {}
    n_rows = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in members]).first()
    for block in recipe.blocks:
        if not isinstance(block, Grams):
            continue
        sums = [F.sum(n).alias(f"df{n}") for n in members]
        if block.most is not None:
            sums += [F.sum(F.col(n) * F.col("c")).alias(f"total{n}") for n in members]
        terms = counts[block.unit].groupBy("term").agg(*sums)
        terms = terms.where(reduce(Column.__or__, [F.col(f"df{n}") >= block.min_rows for n in members]))
        if block.most is not None:
            terms = _most_frequent(cut_lineage(terms), block, list(members))
        idf = [
            F.when((F.col(f"df{n}") >= block.min_rows) & (F.col(f"df{n}") > 0),
                   F.log(F.lit(1.0 + n_rows[n]) / (F.col(f"df{n}") + 1.0)) + 1.0).alias(name)
            for n, name in members.items()
        ]
        terms = terms.select("term", *idf).where(F.coalesce(*members.values()).isNotNull())
        found = Vocabulary.of(cut_lineage(position_rows(terms, [F.col("term")], "place")))
        known = found.rows.agg(*[F.count(name).alias(name) for name in members.values()]).first()
        if not all(known):
            raise ValueError(f"no {block.unit} n-gram occurs in {block.min_rows} rows")
        blocks[block.unit] = found
    return blocks


def _most_frequent(terms: DataFrame, block: Grams, members: list[str]) -> DataFrame:
    """``terms`` with a document frequency of 0 for each fit in whose most frequent ones they are not."""
    for n in members:
        often = terms.where(F.col(f"df{n}") >= block.min_rows).orderBy(F.desc(f"total{n}"), "term").limit(block.most)
        terms = terms.join(often.select("term", F.lit(True).alias(f"top{n}")), "term", "left")
    return terms.select("term", *[F.when(F.col(f"top{n}"), F.col(f"df{n}")).otherwise(0).alias(f"df{n}") for n in members])


def _cue_scale(rows: DataFrame, member: str) -> list[float]:
    """1 / population deviation of each of ``_cues`` in the training rows, 1 for a constant cue."""
    each = rows.select("_cues", F.explode(F.array_repeat(F.lit(0), F.col(member).cast("int"))))
    spread = each.agg(*[F.stddev_pop(F.get("_cues", i)).alias(n) for i, n in enumerate(ENDPOINT_NAMES)]).first()
    return [1.0 / s if s and s > 0 else 1.0 for s in spread]


def _solver(how: Linear, total_weight: float):
    shared = {
        "featuresCol": "features",
        "labelCol": "label",
        "weightCol": "weight",
        "regParam": 1.0 / (how.trust * total_weight),
        "standardization": False,
        "fitIntercept": False,
        "maxIter": how.rounds,
    }
    if how.loss == "hinge":
        return LinearSVC(**shared)
    if how.loss == "logistic":
        return LogisticRegression(elasticNetParam=0.0, family="binomial", **shared)
    raise ValueError(f"unknown loss: {how.loss}")


def fit_classifier(vectors: DataFrame, how: Linear, member: str | None = None):
    """Linear model on (label, features), balanced by weights when asked for.

    Column ``member`` says how often each row counts; its copies are made from the stored vectors.
    """
    often = [] if member is None else [member]
    data = stored(vectors.select(F.col("label").cast("double").alias("label"), "features", *often))
    if member is not None:
        data = data.select("label", "features", F.explode(F.array_repeat(F.lit(0), F.col(member).cast("int")))).drop("col")
    data = balanced_weights(data) if "weights" in how.even else data.withColumn("weight", F.lit(1.0))
    total = data.agg(F.sum("weight")).first()[0]
    return _solver(how, total).fit(data)


@dataclass(frozen=True)
class TextModel:
    """Features and classifier fitted on the same rows."""

    features: TextFeatures
    classifier: object

    def scores(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the signed distance from the decision boundary."""
        vectors = self.features.transform(df)
        kept = [c for c in vectors.columns if c != "features"]
        scored = self.classifier.transform(vectors.select(*kept, "features"))
        value = binary_score(F.col("rawPrediction"))
        return scored.select(*kept, value.alias("score"))

    def save(self, path: str) -> None:
        """Classifier, vocabularies and settings below one folder."""
        spark = SparkSession.active()
        features = self.features
        self.classifier.write().overwrite().save(f"{path}/classifier")
        for name, vocabulary in features.blocks.items():
            vocabulary.rows.write.mode("overwrite").parquet(f"{path}/{name}")
        row = (json.dumps(asdict(features.recipe)), list(features.blocks), features.cue_scale)
        schema = "recipe string, blocks array<string>, cue_scale array<double>"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> TextModel:
        spark = SparkSession.active()
        row = spark.read.parquet(f"{path}/settings").first()
        recipe = _recipe(json.loads(row["recipe"]))
        blocks = {name: Vocabulary.of(spark.read.parquet(f"{path}/{name}")) for name in row["blocks"]}
        kind = LinearSVCModel if recipe.classifier.loss == "hinge" else LogisticRegressionModel
        features = TextFeatures(recipe, blocks, row["cue_scale"] and list(row["cue_scale"]))
        return cls(features, kind.load(f"{path}/classifier"))


def _recipe(saved: dict) -> TextRecipe:
    blocks = tuple(Cues() if b["unit"] == "cues" else Grams(**b) for b in saved["blocks"])
    how = saved["classifier"]
    return TextRecipe(saved["name"], blocks, Linear(**{**how, "even": tuple(how["even"])}))


def fit_text_model(train: DataFrame, recipe: TextRecipe, seed: int = 42) -> TextModel:
    """Fit on (id, text, label); oversampling copies enter the statistics like other rows."""
    rows = _numbered(train.select("id", "text", "label", F.lit(1).cast("bigint").alias("_n")))
    if "copies" in recipe.classifier.even:
        rows = cut_lineage(rows.drop("_n").join(_drawn(rows, seed).withColumnRenamed("n", "_n"), "_row"))
    counts = _member_counts(rows, _counts(rows, recipe), ["_n"])
    features = _fitted(rows, counts, recipe)
    return TextModel(features, fit_classifier(features.vectors(rows, counts), recipe.classifier, "_n"))


@dataclass(frozen=True)
class FoldRows:
    """Stored rows (id, label, fold, ...) of ``placed`` with the weights of their n-grams in the fit of each fold.

    N-grams are cut, counted and numbered once for all folds. Places are those of all folds' terms; a fold's own
    vocabulary, frequencies and scale come from its training rows alone, and other terms have no weight in it.
    """

    recipe: TextRecipe
    rows: DataFrame
    bounds: list[tuple[int, int]]

    @classmethod
    def of(cls, placed: DataFrame, recipe: TextRecipe, folds: int, seed: int) -> FoldRows:
        rows = _numbered(placed.select("id", "text", "label", "fold"))
        members = {f"_n{f}": f"idf{f}" for f in range(folds)}
        rows = cut_lineage(_fold_members(rows, recipe, folds, seed))
        counts = _member_counts(rows, _counts(rows, recipe), list(members))
        bounds, entries = _entries(_vocabularies(rows, counts, recipe, members), counts)
        cues = _cues() if recipe.block("cues") else F.array()
        plain = rows.select(*[c for c in rows.columns if c != "text"], cues.cast("array<double>").alias("_cues"))
        return cls(recipe, stored(_with_entries(plain, entries, [f"w{f}" for f in range(folds)])), bounds)

    def side_by_side(self) -> int:
        """Fits at once: the solvers' arrays are on the driver, and as long as the vocabulary."""
        terms = self.bounds[-1][1] if self.bounds else 0
        return max(1, min(PARALLEL_FITS, FIT_BYTES // (8 * SOLVER_NUMBERS * max(terms, 1))))

    def held_out(self, fold: int) -> DataFrame:
        """(fold, id, label, score) of the rows of ``fold`` by the model of the others."""
        member = f"_n{fold}"
        scale = _cue_scale(self.rows, member) if self.recipe.block("cues") else []

        def vectors(rows: DataFrame) -> DataFrame:
            part = rows.select("id", "label", "fold", member, "_cues", "_places", F.col(f"w{fold}").alias("_weights"))
            return _assembled(part, self.bounds, scale)

        model = fit_classifier(vectors(self.rows.where(F.col(member) > 0)), self.recipe.classifier, member)
        scored = model.transform(vectors(self.rows.where(F.col("fold") == fold)))
        return scored.select("fold", "id", "label", binary_score(F.col("rawPrediction")).alias("score"))


def _fold_members(rows: DataFrame, recipe: TextRecipe, folds: int, seed: int) -> DataFrame:
    """Add _n0, _n1, ...: how often each row is in the training rows of each fold."""
    if "copies" not in recipe.classifier.even:
        return rows.select("*", *[(F.col("fold") != f).cast("bigint").alias(f"_n{f}") for f in range(folds)])

    def drawn(fold: int) -> DataFrame:
        return _drawn(rows.where(F.col("fold") != fold), seed + fold + 1).withColumn("of", F.lit(fold))

    with ThreadPoolExecutor(folds) as pool:
        draws = reduce(DataFrame.unionByName, pool.map(drawn, range(folds)))
    wide = draws.groupBy("_row").agg(*[F.sum(F.when(F.col("of") == f, F.col("n"))).alias(f"_n{f}") for f in range(folds)])
    return rows.join(wide, "_row", "left").fillna(0, [f"_n{f}" for f in range(folds)])


def stack_oof(
    oof: DataFrame, models: list[str], c: float = 1.0, folds: int = 5, seed: int = 42
) -> tuple[object, DataFrame]:
    """Logistic regression on the models' out-of-fold scores; returns (model, scored rows).

    ``oof`` has model, id, label, score with one row per model and id. The returned model is fitted on
    all rows, for new data; each row (id, label, fold, score) is scored by a stacker that was fitted on
    the other folds.
    """
    wide = oof.groupBy("id", "label").agg(
        *[F.max(F.when(F.col("model") == n, F.col("score"))).alias(f"m{i}") for i, n in enumerate(models)]
    )
    names = [f"m{i}" for i in range(len(models))]
    placed = stratified_kfold(wide, folds, seed)
    data = cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(placed))

    def fit(rows: DataFrame):
        estimator = LogisticRegression(
            featuresCol="features",
            labelCol="label",
            regParam=1.0 / (c * rows.count()),
            standardization=False,
        )
        return estimator.fit(rows)

    def held_out(fold: int) -> DataFrame:
        inside = F.col("fold") == fold
        return fit(data.where(~inside)).transform(data.where(inside)).select(
            "id", "label", "fold", F.get(vector_to_array("probability"), 1).alias("score")
        )

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        whole = pool.submit(fit, data)
        scored = reduce(DataFrame.unionByName, pool.map(held_out, range(folds)))
        return whole.result(), scored
