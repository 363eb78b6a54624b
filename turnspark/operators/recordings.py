"""Zero-phase filters over recordings that are cut into chunks.

A recursive filter carries a small state from sample to sample, and n samples turn it into
``C^n state + v``: C depends on the filter alone, v is what the chunk leaves behind when it starts
from rest. Such maps compose, so every chunk's state at entry follows from (n, v) of the chunks
before it, and the samples themselves are filtered chunk by chunk in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnspark.functions import filters
from turnspark.lineage import cut_lineage
from turnspark.operators.trials import _nested
from turnspark.skew import lookup_join

SPAN = 1 << 20  # positions whose chunks are composed by one task
FANOUT = 1 << 10  # composed runs that one task composes further
GONE = 1e-40  # a state that has shrunk by this factor counts as zero
MAP_FIELDS = "pos long, n long, v array<double>, first array<double>"


def _filtered(b, a, xs, channels, states=None):
    """Filtered flat rows and their last states; rows of one shape go through together."""
    order = len(a) - 1
    outs, lasts = [None] * len(xs), [None] * len(xs)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, c) in enumerate(zip(xs, channels)):
        shapes.setdefault((len(x), c), []).append(i)
    for (size, c), rows in shapes.items():
        data = np.stack([xs[i] for i in rows]).reshape(len(rows) * c, size // c)
        state = np.zeros((len(data), order))
        if states is not None:
            state[:] = np.stack([states[i] for i in rows]).reshape(state.shape)
        flat = filters.run_filter(b, a, data, state).reshape(len(rows), -1)
        for i, y, s in zip(rows, flat, state.reshape(len(rows), -1)):
            outs[i], lasts[i] = y, s
    return outs, lasts


def _turned(xs, channels, backward):
    if not backward:
        return list(xs)
    return [np.asarray(x).reshape(c, -1)[:, ::-1].ravel() for x, c in zip(xs, channels)]


def _rest_map(b, a, backward):
    """(samples, channels) -> state left behind from rest and first sample of every channel."""

    @pandas_udf("v array<double>, first array<double>")
    def found(x: pd.Series, channels: pd.Series) -> pd.DataFrame:
        xs = _turned(x, channels, backward)
        _, lasts = _filtered(b, a, xs, channels)
        firsts = [row.reshape(c, -1)[:, 0] for row, c in zip(map(np.asarray, xs), channels)]
        return pd.DataFrame({"v": lasts, "first": firsts})

    return found


def _from_state(b, a, backward):
    @pandas_udf("array<double>")
    def found(x: pd.Series, channels: pd.Series, state: pd.Series) -> pd.Series:
        outs, _ = _filtered(b, a, _turned(x, channels, backward), channels, list(state))
        return pd.Series(_turned(outs, channels, backward), dtype=object)

    return found


class _Walk:
    """Steps of the state over runs of samples without input, plus what each run leaves behind."""

    def __init__(self, a: np.ndarray):
        self.order = len(a) - 1
        self.step = np.zeros((self.order, self.order))
        self.step[:, 0] = -a[1:]
        self.step[:-1, 1:] = np.eye(self.order - 1)
        self.powers: dict[int, np.ndarray] = {}

    def power(self, n: int) -> np.ndarray:
        """``step`` n times, one at a time: squares of it grow first and would cost half the digits.

        A stable filter forgets, so the loop ends once nothing of the state is left.
        """
        if n not in self.powers:
            power = np.eye(self.order)
            for _ in range(n):
                power = self.step @ power
                if np.abs(power).max() < GONE:
                    power[:] = 0.0
                    break
            self.powers[n] = power
        return self.powers[n]

    def after(self, state: np.ndarray, n: int, v) -> np.ndarray:
        return state @ self.power(n).T + np.asarray(v).reshape(state.shape)

    def entries(self, maps: pd.DataFrame, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """State before each of the maps (in order of ``pos``), and the one behind the last."""
        out, end = [], None
        for pos, n, v in zip(maps["pos"], maps["n"], maps["v"]):
            if end is not None and pos != end:
                raise ValueError(f"chunks leave a gap or overlap between positions {min(pos, end)} and {max(pos, end)}")
            out.append(state.ravel())
            state, end = self.after(state, int(n), v), pos + n
        return out, state


def _entry_states(maps: DataFrame, keys: list[str], b, a, length: int, span: int, fanout: int) -> DataFrame:
    """``keys``, ``pos`` and ``state`` at the entry of every chunk.

    Maps of the chunks within ``span`` positions are composed by one task, then those of
    ``fanout`` such runs, and so on until one run holds a whole recording; the states travel
    back the same way. No task sees more rows than a run has parts.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maps.schema.fields if f.name in keys)
    flat = b.size - 1
    steady = filters.steady_state(b, a)

    def run_of(width: int) -> Column:
        return F.floor(F.col("pos") / F.lit(width)).cast("long")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        head = rows.iloc[:1].copy()
        _, last = _Walk(a).entries(rows, np.zeros((len(head["v"].iloc[0]) // flat, flat)))
        head["n"], head["v"] = rows["n"].sum(), [last.ravel()]
        return head[[*keys, "pos", "n", "v", "first"]]

    def from_start(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        state = np.asarray(rows["first"].iloc[0])[:, None] * steady[None, :]
        return rows[[*keys, "pos"]].assign(state=_Walk(a).entries(rows, state)[0])

    def within(rows: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        state = np.array(run["state"].iloc[0]).reshape(-1, flat)
        return rows[[*keys, "pos"]].assign(state=_Walk(a).entries(rows, state)[0])

    levels, widths = [maps], []
    while length > span:
        widths.append(span)
        runs = levels[-1].withColumn("_run", run_of(span)).groupBy(*keys, "_run")
        levels.append(cut_lineage(runs.applyInPandas(compose, f"{names}, {MAP_FIELDS}")))
        span *= fanout
    fields = f"{names}, pos long, state array<double>"
    states = levels[-1].groupBy(*keys).applyInPandas(from_start, fields)
    for parts, width in zip(levels[-2::-1], widths[::-1]):
        left = parts.withColumn("_run", run_of(width)).groupBy(*keys, "_run")
        right = states.withColumn("_run", run_of(width)).groupBy(*keys, "_run")
        states = left.cogroup(right).applyInPandas(within, fields)
    return states


def _one_way(rows: DataFrame, keys: list[str], b, a, backward: bool, length: int, span: int, fanout: int) -> DataFrame:
    pos = -(F.col("_at") + F.col("_n")) if backward else F.col("_at")
    rest = _rest_map(b, a, backward)(F.col("_x"), F.col("_channels"))
    maps = rows.select(*keys, pos.alias("pos"), F.col("_n").alias("n"), rest.alias("m"))
    maps = cut_lineage(maps.select(*keys, "pos", "n", "m.v", "m.first"))
    states = _entry_states(maps, keys, b, a, length, span, fanout)
    joined = rows.withColumn("pos", pos).join(states, [*keys, "pos"]).drop("pos")
    out = _from_state(b, a, backward)(F.col("_x"), F.col("_channels"), F.col("state"))
    return cut_lineage(joined.withColumn("_x", out).drop("state"))


def _with_edges(rows: DataFrame, keys: list[str], ends: DataFrame, pad: int) -> DataFrame:
    """Rows and, before and behind each recording, ``pad`` samples mirrored in its end points."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    fields = f"{names}, _at long, _n long, _channels int, _x array<double>"

    def extend(part: pd.DataFrame) -> pd.DataFrame:
        first, last = int(part["_first"].iloc[0]), int(part["_last"].iloc[0])
        if last - first <= pad:
            raise ValueError(f"signals need more than {pad} samples, got {last - first}")
        channels = int(part["_channels"].iloc[0])
        cuts = {}
        for low in (first, last - pad - 1):
            cut = np.full((channels, pad + 1), np.nan)
            for at, x in zip(part["_at"], part["_x"]):
                x = np.asarray(x).reshape(channels, -1)
                start, stop = max(at, low), min(at + x.shape[1], low + pad + 1)
                if start < stop:
                    cut[:, start - low : stop - low] = x[:, start - at : stop - at]
            cuts[low] = cut
        head, tail = cuts[first], cuts[last - pad - 1]
        left = 2 * head[:, :1] - head[:, :0:-1]
        right = 2 * tail[:, -1:] - tail[:, -2::-1]
        out = pd.concat([part[keys].iloc[:1]] * 2, ignore_index=True)
        return out.assign(_at=[first - pad, last], _n=pad, _channels=channels, _x=[left.ravel(), right.ravel()])

    places = lookup_join(rows.select(*keys, "_at", "_n"), ends, keys, ["_at"])
    near = places.where("_at <= _first + {0} or _at + _n >= _last - {0}".format(pad)).drop("_n")
    ends_only = rows.drop("_others").join(near, [*keys, "_at"]).groupBy(*keys).applyInPandas(extend, fields)
    edges = ends_only.withColumn("_edge", F.lit(True))
    return rows.withColumn("_edge", F.lit(False)).unionByName(edges, allowMissingColumns=True)


def filter_recordings(
    df: DataFrame,
    designs: Sequence[tuple],
    keys: Sequence[str],
    start: str = "start",
    x: str = "x",
    span: int = SPAN,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every recording through the (b, a) ``designs`` in turn, without phase shift, chunk by chunk.

    A row is a chunk: ``keys`` name the recording, ``start`` is the place of the chunk's first
    sample in it, ``x`` holds channels x time. Chunks may be of any length, one sample included,
    and of different lengths; the result is that of ``filter_signals`` on the whole recording.
    Other columns stay. Rows whose key or start is null, or without samples, are left out; an
    empty table gives an empty one. Chunks that overlap (repeated rows do) or leave a gap raise,
    as does a recording that is not longer than a filter's edge.

    Each direction shuffles the samples by recording and place, so a long recording spreads over
    all tasks; finding the chunks at the ends may shuffle them once more for each design. The driver
    sees one number, the longest recording's length.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in (*keys, start, x)]
    rows = df.select(
        *[F.col(f"`{k}`") for k in keys],
        F.col(f"`{start}`").cast("long").alias("_at"),
        F.flatten(F.col(f"`{x}`").cast("array<array<double>>")).alias("_x"),
        F.size(f"`{x}`").cast("int").alias("_channels"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others"),
    )
    given = F.col("_at").isNotNull() & (F.size("_x") > 0)
    for k in keys:
        given = given & F.col(f"`{k}`").isNotNull()
    rows = rows.where(given).withColumn("_n", (F.size("_x") / F.col("_channels")).cast("long"))
    ends = cut_lineage(rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max(F.col("_at") + F.col("_n")).alias("_last")))
    length = ends.agg(F.max(F.col("_last") - F.col("_first"))).first()[0] or 0
    for b, a in designs:
        pad = 3 * max(len(a), len(b))
        b, a = (np.pad(np.asarray(c, dtype=float), (0, max(len(a), len(b)) - len(c))) for c in (b, a))
        wide = cut_lineage(_with_edges(rows, keys, ends, pad))
        for backward in (False, True):
            wide = _one_way(wide, keys, b, a, backward, length + 2 * pad, span, fanout)
        rows = wide.where(~F.col("_edge")).drop("_edge")
    signal = _nested(F.col("_x"), F.col("_channels"))
    result = {**{k: F.col(f"`{k}`") for k in keys}, start: F.col("_at"), x: signal}
    return rows.select(*[result.get(c, F.col("_others").getField(c)).alias(c) for c in df.columns])
