"""Epochs of the event table, and turns scored as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnspark.lineage import ensure_checkpoint_dir
from turnspark.queries import views as v
from turnspark.queries.registry import query
from turnspark.streaming import epochs, scoring

CHANNELS = ("click", "error", "purchase", "signup", "view")
DAY, SIX_HOURS = 86_400, 21_600
CLOCK = "yyyy-MM-dd HH:mm:ss"


def _epoch_sql(step: int) -> str:
    cells = ", ".join(
        "["
        + ", ".join(
            f"coalesce(sum(value::DECIMAL(28,6)) FILTER (event_type = '{c}' AND bin = {b}), 0)::DOUBLE"
            for b in range(4)
        )
        + "]"
        for c in CHANNELS
    )
    return f"""WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) AS us,
        epoch_us(ts) // {step * 1_000_000} * {step} AS last_start FROM events WHERE ts IS NOT NULL),
    w AS (SELECT *, unnest(range(0, {DAY // step})) AS k FROM e),
    p AS (SELECT *, last_start - k * {step} AS s FROM w),
    b AS (SELECT *, (us - s * 1000000) // {SIX_HOURS * 1_000_000} AS bin FROM p)
    SELECT user_id AS subject, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS start,
      count(*) AS n, [{cells}] AS x FROM b GROUP BY user_id, s"""


def _epochs(spark, sf_dir, slide):
    trials = epochs.epoch_events(v.table(spark, sf_dir, "events"), CHANNELS, DAY, 4, slide)
    return trials.withColumn("start", F.date_format("start", CLOCK))


@query("epoch_events", _epoch_sql(DAY))
def epoch_query(spark, sf_dir):
    """One trial per user and day: five channels of four six-hour sums."""
    return _epochs(spark, sf_dir, DAY)


@query("hopping_epochs", _epoch_sql(SIX_HOURS))
def hopping_query(spark, sf_dir):
    """The same days, one starting every six hours."""
    return _epochs(spark, sf_dir, SIX_HOURS)


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, value, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
    o AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000, TRUE)
          AS opens FROM e),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY us) AS run FROM o)
    SELECT user_id AS subject, strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') AS first,
      strftime(make_timestamp(max(us)), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n,
      coalesce(sum(value::DECIMAL(28,6)), 0)::DOUBLE AS total FROM s GROUP BY user_id, run""",
)
def session_query(spark, sf_dir):
    """Runs of a user's events at most six hours apart."""
    runs = epochs.sessions(v.table(spark, sf_dir, "events"), SIX_HOURS)
    clock = {c: F.date_format(c, CLOCK) for c in ("first", "last")}
    return runs.withColumns(clock)


@query(
    "stream_scores",
    f"""WITH every AS (SELECT doc_id AS id, text FROM documents), {v.sql_scored('every', 'out')}
    SELECT id, prob, (prob >= 0.5)::INT AS label FROM out""",
)
def stream_query(spark, sf_dir):
    """All documents read as a stream, scored, written, and read back."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = v.table(spark, sf_dir, "documents")
    # A pattern, as a stream takes single files by pattern only.
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents*.parquet")
    rows = arriving.select(F.col("doc_id").alias("id"), "text")
    scored = scoring.score_turns(rows, v.CUE_WEIGHTS, v.CUE_INTERCEPT)
    scoring.write_scores(scored, f"{base}/rows", f"{base}/progress", True).awaitTermination()
    return scoring.read_scores(spark, f"{base}/rows")
