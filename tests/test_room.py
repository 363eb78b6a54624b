"""What a step holds or stores must not grow faster than its input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.functions.text import word_ngrams
from turnspark.lineage import cut_lineage, ensure_checkpoint_dir
from turnspark.models import trial_models as tm
from turnspark.operators import tfidf as tf
from turnspark.plans import shared_sweep as ss


def test_texts_are_spread_by_their_size(spark):
    small = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.range(24).withColumn("text", F.repeat(F.concat(F.lit("word "), F.col("id")), 80_000))
    for df in (texts, texts.limit(1)):
        counts = tf.term_counts(df, word_ngrams(F.col("text"), 1, 1))
        assert counts.agg(F.sum("c")).first()[0] >= 80_000
    assert tf.term_counts(texts, word_ngrams(F.col("text"), 1, 1)).select(F.spark_partition_id().alias("p")).distinct().count() > small


def _turns(spark):
    rows = [(i, " ".join(["red fox ran", "blue cat sat", "old dog"][i % 3 :]) + f" x{i % 5}", int(i % 4 < 2)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_only_used_units_are_counted(spark):
    words = ss.prepare(_turns(spark), [ss.Config("w", (1, 2))], 3, 7)
    kinds = {(r["unit"], r["size"]) for r in words.vocabulary.collect()}
    assert kinds == {("word", 1), ("word", 2)}
    others = spark.createDataFrame([(100, "a red fox"), (101, "")], "id long, text string")
    cues = ss.Config("cues", cues=True, loss="logistic", weights=True)
    assert ss.prepare(_turns(spark), [cues], 3, 7, others).vocabulary.isEmpty()
    predicted, own = ss.bagged_predict(_turns(spark), others, cues, 3, 7)
    assert predicted.count() == 2 and own.count() == 60


@pytest.mark.parametrize("kind", ["csp_lda", "tangent", "mdm", "xdawn"])
def test_fits_on_stored_windows_store_nothing_more(spark, kind):
    """Ten fits of wide features once left ten copies of them in the checkpoint folder."""
    rng = np.random.default_rng(5)
    rows = [(i % 3, i, i % 2, (rng.normal(size=(3, 16)) * (1 + i % 2)).tolist()) for i in range(60)]
    trials = spark.createDataFrame(rows, "subject int, trial long, y int, x array<array<double>>")
    recipe = tm.TrialRecipe(kind, 8, 4, (0, 1), 2)
    windows = cut_lineage(recipe.windows(trials))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def stored() -> int:
        return sum(name.startswith("part-") for _, _, names in os.walk(folder) for name in names)

    before = stored()
    assert before > 0
    model = recipe.fit(windows)
    again = stored()
    assert model.score(windows).count() == windows.count() and again == before
