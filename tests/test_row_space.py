"""Models fitted in the space of the rows: the weights' models of ``sparse_linear``, without a number for a term on the driver."""

import numpy as np
from pyspark.sql import functions as F
from test_shared_sweep import turns

from turnspark.models import row_space as rs
from turnspark.models.sparse_linear import fit_many
from turnspark.plans import shared_sweep as ss
from turnspark.shipping import ship_package

CONFIGS = (
    ss.Config("w", (1, 2), copies=True), ss.Config("c", char=(4, 6), loss="logistic", trust=2.0),
    ss.Config("u", (1, 3), (3, 6), trust=0.5, weights=True), ss.Config("cues", (1, 1), cues=True, loss="logistic"),
)


def test_margins_are_those_of_the_weights(spark, monkeypatch):
    """Repeated ids included; small blocks, a dense share of the columns, and several runs of the solver."""
    ship_package(spark)
    data = turns(spark).union(turns(spark).where("id < 3"))
    monkeypatch.setattr(rs, "STATE", 12 * data.count())
    sweep = ss.prepare_sweep(data, CONFIGS, 3, 5)
    assert len(sweep.space.groups([ss.fit_of(sweep, c, f) for c in CONFIGS for f in range(3)])) > 1
    solved = ss.cross_validate_all(sweep, CONFIGS, 1e-7)
    got = {}
    for fits, wide in solved.margins:
        for r in wide.collect():
            for f, s in zip(fits, r["scores"]):
                got.setdefault((r["id"], f.name, f.fold), []).append(s)
    others = CONFIGS[:3]  # the other solver takes hundreds of passes where there are cues
    plain = ss.prepare(data, others, 3, 5)
    fits = [ss.fit_of(plain, c, f) for c in others for f in range(3)]
    wide = fit_many(plain.rows, plain.blocks, fits, 1e-6).scores(plain.rows, ["id"]).collect()
    assert len(wide) == sweep.space.cols.n
    for r in wide:
        for f, s in zip(fits, r["scores"]):
            assert np.allclose(got[r["id"], f.name, f.fold], s, atol=1e-4)


def test_equal_columns_are_stored_once(spark):
    ship_package(spark)
    rows = [("word", 1, [0, 2], [1, 3]), ("word", 2, [0, 2], [1, 3]), ("word", 1, [0, 2], [1, 1]), ("char", 3, [0, 2], [1, 3]), ("word", 1, [1], [5])]
    found = rs.columns(spark.createDataFrame(rows, rs.POSTINGS), np.ones((3, 1)), np.ones(3), np.array([3.0]), 2)
    blocks = [rs.Block.read(b, i, 1) for b in found.blocks.toArrow().to_batches() for i in range(b.num_rows)]
    assert sorted(m for b in blocks for m in b.members) == [1, 1, 2]
    view = [rs.View("word", (1, 2), 0)]
    idf = np.log(4 / 3) + 1
    assert np.isclose(sum(b.squares(view, found.sizes, 2).sum() for b in blocks if b.unit == "word"), 3 * idf**2)


def test_nothing_of_the_terms_is_collected(spark, monkeypatch):
    """The driver's tables have a size that the rows set: ten times the terms do not change them."""
    ship_package(spark)
    data = turns(spark)
    wide = data.withColumn("text", F.concat("text", F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.concat(F.lit("zz"), i)), " ")))
    shapes = []
    for df in (data, wide):
        sweep = ss.prepare_sweep(df, CONFIGS[:1], 3, 5)
        shapes.append([x.shape for x in (sweep.space.scales, sweep.space.weights, *(t for pair in sweep.space.dense.values() for t in pair))])
    assert shapes[0] == shapes[1]
