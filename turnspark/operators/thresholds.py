"""Decision thresholds from one pass over the scores.

Scores are counted per grid step; cumulative sums over at most a few hundred
steps then give the confusion counts at every threshold at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnspark.lineage import cut_lineage
from turnspark.operators.bounded import MAX_GROUPS
from turnspark.ranking import exact_quantiles, position_rows

SCORE_STEPS = 401


@dataclass(frozen=True)
class Grid:
    """Thresholds low, low + step, ... and optionally 0, ascending and distinct."""

    low: float
    step: float
    points: int
    with_zero: bool = False

    def linear(self) -> list[float]:
        return [self.low + i * self.step for i in range(self.points)]

    def values(self) -> list[float]:
        extra = {0.0} if self.with_zero else set()
        return sorted(set(self.linear()) | extra)

    def reached(self, score: Column) -> Column:
        """How many thresholds the score reaches.

        The division only guesses the step; comparing with the very values of the grid
        then settles it, so scores on a grid point are counted exactly.
        """
        low, step = F.lit(self.low), F.lit(self.step)
        if self.step > 0:
            guess = F.least(F.floor((score - low) / step), F.lit(self.points - 1))
            guess = F.greatest(guess, F.lit(-1)).cast("int")
            too_far = (guess >= 0) & (low + guess * step > score)
            too_short = (guess < self.points - 1) & (low + (guess + 1) * step <= score)
            count = guess + 1 - too_far.cast("int") + too_short.cast("int")
        else:
            count = (score >= low).cast("int")
        if self.with_zero and 0.0 not in self.linear():
            count = count + (score >= 0).cast("int")
        return count

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (step, threshold), step counting from 1."""
        rows = [(i + 1, t) for i, t in enumerate(self.values())]
        return spark.createDataFrame(rows, "step int, threshold double")


def prob_grid(low: float = 0.30, high: float = 0.70, step: float = 0.01) -> Grid:
    """Probability thresholds low, low + step, ... up to high."""
    return Grid(low, step, int((high - low) / step + 0.5) + 1)


def threshold_grid(df: DataFrame, score: str, points: int = SCORE_STEPS) -> Grid:
    """Linear grid between the 1st and 99th percentile (whole finite range if they meet), with 0."""
    low, high = exact_quantiles(df, score, [0.01, 0.99], infinite=True)
    if low == high:
        finite = df.where(F.abs(score) < float("inf"))
        edge = finite.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
        low, high = edge[0], edge[1]
    if low == high:
        return Grid(low, 0.0, 1, with_zero=True)
    return Grid(low, (high - low) / (points - 1), points, with_zero=True)


def sweep(
    df: DataFrame,
    grid: Grid,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and macro-F1 (over the classes seen) at every threshold.

    ``by`` names small keys such as config or fold.
    """
    by = list(by)
    counted = (
        df.select(*by, F.col(label).alias("_y"), grid.reached(F.col(score)).alias("step"))
        .groupBy(*by, "step")
        .agg(
            F.count_if(F.col("_y") == 1).alias("pos"),
            F.count_if(F.col("_y") == 0).alias("neg"),
        )
    )
    # Every key gets every step: thresholds without scores of their own count too.
    # Step 0 collects the scores below the grid.
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("threshold"))
            for i, t in enumerate(grid.values())
        ]
    )
    keys = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).drop("_n") if by else (
        df.sparkSession.range(1).drop("id")
    )
    frame = keys.select(*by, F.explode(steps).alias("_t")).select(*by, "_t.*")
    return _confusions(counted, frame, by)


def _confusions(counted: DataFrame, frame: DataFrame, by: list[str]) -> DataFrame:
    """From label counts (by, step, pos, neg) to the confusion counts at each (by, step, threshold) of ``frame``."""
    full = frame.join(counted, [*by, "step"], "full_outer").fillna(0, ["pos", "neg"])
    up = W.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    tp, fp = F.sum("pos").over(up), F.sum("neg").over(up)
    counts = full.select(
        *by,
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("pos").over(whole) - tp).alias("fn"),
        (F.sum("neg").over(whole) - fp).alias("tn"),
    ).where("threshold is not null")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    f0 = 2 * F.col("tn") / (2 * F.col("tn") + F.col("fp") + F.col("fn"))
    seen1 = F.col("tp") + F.col("fp") + F.col("fn") > 0
    seen0 = F.col("tn") + F.col("fp") + F.col("fn") > 0
    total = F.when(seen1, f1).otherwise(0.0) + F.when(seen0, f0).otherwise(0.0)
    return counts.select(
        *by,
        "threshold",
        "tp",
        "fp",
        "fn",
        "tn",
        (total / (seen1.cast("int") + seen0.cast("int"))).alias("macro_f1"),
    )


def best_threshold(swept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold among those with the best macro-F1."""
    pick = F.max_by(
        F.struct("threshold", "macro_f1", "tp", "fp", "fn", "tn"),
        F.struct(F.col("macro_f1").alias("a"), (-F.col("threshold")).alias("b")),
    )
    return swept.groupBy(*by).agg(pick.alias("best")).select(*by, "best.*")


def tune_threshold_probs(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    low: float = 0.30,
    high: float = 0.70,
    step: float = 0.01,
) -> DataFrame:
    """Best probability threshold on a fixed grid."""
    return best_threshold(sweep(df, prob_grid(low, high, step), score, label, by), by)


def tune_threshold_scores(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Best threshold for signed scores; the grid follows the score percentiles.

    The percentiles take several passes, so the two columns are written once first.
    """
    pairs = cut_lineage(df.select(score, label))
    return best_threshold(sweep(pairs, threshold_grid(pairs, score), score, label))


def tune_thresholds_by(df: DataFrame, by: str, score: str = "score", label: str = "label") -> DataFrame:
    """:func:`tune_threshold_scores` for every value of ``by``, a small key such as the configuration, in one go.

    One sort gives the percentiles of all keys, one aggregation the counts at all their thresholds.
    """
    spark = df.sparkSession
    pairs = df.select(by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y")).where("_s is not null")
    placed = position_rows(pairs, [F.col(by), F.col("_s")], "_pos")
    spans = placed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("at"), F.min("_s").alias("low"), F.max("_s").alias("high"))
    spans = spans.limit(MAX_GROUPS + 1).collect()
    if len(spans) > MAX_GROUPS:
        raise ValueError(f"{by} has more than {MAX_GROUPS} values")
    ranks = {r[by]: [p * (r["n"] - 1) for p in (0.01, 0.99)] for r in spans}
    wanted = {r["at"] + f(x) for r in spans for x in ranks[r[by]] for f in (math.floor, math.ceil)}
    known = spark.createDataFrame([(int(p),) for p in wanted], "_pos long")
    value = {r["_pos"]: r["_s"] for r in placed.join(F.broadcast(known), "_pos").select("_pos", "_s").collect()}
    rows, points = [], []
    for r in spans:
        if not (math.isfinite(r["low"]) and math.isfinite(r["high"])):
            raise ValueError(f"{score} holds values that are not finite")
        low, high = (value[r["at"] + math.floor(x)] + (value[r["at"] + math.ceil(x)] - value[r["at"] + math.floor(x)]) * (x - math.floor(x))
                     for x in ranks[r[by]])
        if low == high:
            low, high = r["low"], r["high"]
        flat = low == high
        grid = Grid(low, 0.0 if flat else (high - low) / (SCORE_STEPS - 1), 1 if flat else SCORE_STEPS, with_zero=True)
        rows.append((r[by], grid.low, grid.step, grid.points, 0.0 not in grid.linear()))
        points += [(r[by], i + 1, t) for i, t in enumerate(grid.values())]
    kind = df.schema[by].dataType.simpleString()
    grids = spark.createDataFrame(rows, f"{by} {kind}, _low double, _step double, _points int, _zero boolean")
    s, low, step, n = F.col("_s"), F.col("_low"), F.col("_step"), F.col("_points")
    guess = F.greatest(F.least(F.floor((s - low) / F.when(step > 0, step)), n - 1), F.lit(-1)).cast("int")
    off = ((guess < n - 1) & (low + (guess + 1) * step <= s)).cast("int") - ((guess >= 0) & (low + guess * step > s)).cast("int")
    reached = F.when(step > 0, guess + 1 + off).otherwise((s >= low).cast("int")) + (F.col("_zero") & (s >= 0)).cast("int")
    counted = placed.join(F.broadcast(grids), by).select(by, "_y", reached.alias("step")).groupBy(by, "step").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    frame = spark.createDataFrame(points, f"{by} {kind}, step int, threshold double")
    return best_threshold(_confusions(counted, frame, [by]), [by])
