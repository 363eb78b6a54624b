"""Epochs in batch and stream, late rows, sessions, and scoring with a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnspark.queries import views as v
from turnspark.streaming import epochs, scoring

SCHEMA = "user_id long, event_type string, value double, ts timestamp"
START = datetime(2024, 1, 1)


def rows(*items):
    return [(u, kind, value, START + timedelta(seconds=s)) for u, kind, value, s in items]


def plain(df):
    return sorted((r["subject"], r["start"], r["n"], r["x"]) for r in df.collect())


def cut(df, slide=None, late="100 seconds"):
    return epochs.epoch_events(df, ["a", "b"], 60, 2, slide, late)


def test_batch_epochs(spark):
    events = rows(
        (1, "a", 1.5, 0), (1, "a", 2.0, 29), (1, "b", 4.0, 30), (1, None, 9.0, 59), (2, "a", None, 61),
        (2, "a", 0.1, 70), (2, "a", 0.1, 70), (2, "other", 3.0, 119), (None, "b", 1.0, 5),
    ) + [(1, "a", 7.0, None)]
    df = spark.createDataFrame(events, SCHEMA).withColumn("start", F.lit("clash"))
    got = {(r["subject"], r["start"]): (r["n"], r["x"]) for r in cut(df).collect()}
    assert got == {
        (1, START): (4, [[3.5, 0.0], [0.0, 4.0]]),
        (2, START + timedelta(seconds=60)): (4, [[0.2, 0.0], [0.0, 0.0]]),
        (None, START): (1, [[0.0, 0.0], [1.0, 0.0]]),
    }
    hops = cut(df, 30).where("subject = 1").orderBy("start").collect()
    assert [(r["n"], r["x"]) for r in hops] == [
        (2, [[0.0, 3.5], [0.0, 0.0]]), (4, [[3.5, 0.0], [0.0, 4.0]]), (2, [[0.0, 0.0], [4.0, 0.0]]),
    ]
    assert cut(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cut(df, 45)


def test_stream_equals_batch_without_late_rows(spark, tmp_path):
    """Three files in turn: late rows within the watermark count, later ones are dropped."""
    first = rows((1, "a", 1.0, 10), (1, "a", 1.0, 300), (2, "b", 2.0, 290))
    second = rows((1, "a", 5.0, 250), (2, "b", 3.0, 400))
    too_late = rows((1, "a", 100.0, 20))
    end = rows((3, "a", 1.0, 10_000))
    source = tmp_path / "in"
    source.mkdir()

    def arrive(items, name):
        spark.createDataFrame(items, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        part = next((tmp_path / "made" / name).glob("part-*"))
        (source / f"{name}.parquet").write_bytes(part.read_bytes())

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        trials = cut(stream)
        writer = trials.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer = writer.option("checkpointLocation", str(tmp_path / "progress"))
        writer.trigger(availableNow=True).start().awaitTermination()

    for name, items in (("f1", first), ("f2", second), ("f3", too_late), ("f4", end)):
        arrive(items, name)
        drain()
    kept = spark.createDataFrame(first + second, SCHEMA)
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(cut(kept))


def test_sessions(spark):
    events = rows((1, "a", 1.0, 0), (1, "a", 2.0, 9), (1, "b", None, 20), (1, "a", 4.0, 20), (1, "a", 1.0, 30), (2, "a", 5.0, 3))
    got = epochs.sessions(spark.createDataFrame(events, SCHEMA), 10).orderBy("subject", "first").collect()
    assert [(r["subject"], (r["last"] - r["first"]).seconds, r["n"], r["total"]) for r in got] == [
        (1, 9, 2, 3.0), (1, 10, 3, 5.0), (2, 0, 1, 5.0),
    ]
    assert got[1]["first"] == START + timedelta(seconds=20)


def test_scored_stream_survives_a_restart(spark, tmp_path):
    texts = ["Well, could you", "", None, "I am done.", "and then?", "Please stop!"]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "id long, text string"

    def score(df):
        return scoring.score_turns(df, v.CUE_WEIGHTS, v.CUE_INTERCEPT)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        scoring.write_scores(score(stream), out, progress, available_now=True).awaitTermination()

    turns = spark.createDataFrame(list(enumerate(texts)), schema)
    turns.where("id < 4").write.parquet(source)
    run()
    run()
    # A commit that is lost makes the restarted stream repeat its last batch.
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"))
    for log in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        log.unlink(missing_ok=True)
    turns.where("id >= 4").write.mode("append").parquet(source)
    run()
    got = sorted(map(tuple, scoring.read_scores(spark, out).collect()))
    assert got == sorted(map(tuple, score(turns).collect())) and len(got) == len(texts)
