"""Filters over chunked recordings against the filter over whole signals."""

import numpy as np
import pytest

from turnspark.functions import filters
from turnspark.operators.recordings import filter_recordings

SCHEMA = "rec string, start long, x array<array<double>>, part int"


def chunks(name, signal, cuts, first=0):
    at = 0
    for i, n in enumerate(cuts):
        yield (name, first + at, signal[:, at : at + n].tolist(), i)
        at += n
    assert at == signal.shape[1]


def whole(rows, name):
    mine = sorted((r["start"], np.array(r["x"])) for r in rows if r["rec"] == name)
    return np.concatenate([x for _, x in mine], axis=1)


def expected(signal, designs):
    for b, a in designs:
        signal = filters.zero_phase(b, a, signal)
    return signal


@pytest.mark.parametrize("span, fanout", [(1 << 20, 1 << 10), (50, 2)])
def test_chunks_of_any_length_equal_the_whole(spark, span, fanout):
    rng = np.random.default_rng(3)
    designs = filters.band_without_hum(8.0, 30.0, 250.0)
    a, b = rng.normal(size=(2, 700)).cumsum(axis=1), rng.normal(size=(2, 90))
    rows = [
        *chunks("a", a, [1, 2, 300, 1, 96, 250, 49, 1]),
        *chunks("b", b, [90], first=-40),
        (None, 0, [[1.0], [2.0]], 0),
        ("b", None, [[1.0], [2.0]], 0),
        ("a", 5000, None, 0),
        ("a", 5000, [[], []], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = filter_recordings(df, designs, ["rec"], span=span, fanout=fanout)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 9 and {r["part"] for r in got} == set(range(8))
    np.testing.assert_allclose(whole(got, "a"), expected(a, designs), atol=1e-9 * np.abs(a).max())
    np.testing.assert_allclose(whole(got, "b"), expected(b, designs), atol=1e-9)


def test_gaps_repeats_short_and_empty(spark):
    designs = [filters.butter_bandpass(1, 20.0, 100.0, 250.0)]
    signal = np.arange(40.0)[None, :]
    good = list(chunks("a", signal, [20, 20]))
    for bad in ([good[0], good[0], good[1]], [good[0], ("a", 21, good[1][2], 1)], [("a", 0, [[1.0, 2.0]], 0)]):
        with pytest.raises(Exception, match="gap or overlap|more than"):
            filter_recordings(spark.createDataFrame(bad, SCHEMA), designs, ["rec"]).collect()
    assert filter_recordings(spark.createDataFrame([], SCHEMA), designs, ["rec"]).count() == 0
