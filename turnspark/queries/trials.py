"""Trials made of the embeddings: windows, covariances, alignment, filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from turnspark.functions import signals
from turnspark.functions.filters import band_without_hum, butter_bandpass, run_filter
from turnspark.operators import trials as tr
from turnspark.operators.recordings import filter_recordings
from turnspark.queries import views as v
from turnspark.queries.registry import query

CHANNELS = 4


def long_form(df, keys, digits=6):
    """Nested x as rows (keys..., ch, t, v)."""
    channels = df.select(*keys, F.posexplode("x").alias("ch", "s"))
    samples = channels.select(*keys, "ch", F.posexplode("s").alias("t", "v"))
    return samples.withColumn("v", F.round("v", digits))


def matrix_rows(df, keys, column, digits=6):
    """A flat matrix as rows (keys..., i, j, v); + 0.0 turns a negative zero into zero."""
    cells = df.select(*keys, F.posexplode(column).alias("p", "v"))
    return cells.select(
        *keys,
        F.floor(F.col("p") / CHANNELS).cast("int").alias("i"),
        (F.col("p") % CHANNELS).alias("j"),
        (F.round("v", digits) + F.lit(0.0)).alias("v"),
    )


@query(
    "profile_trials",
    """SELECT CAST(vec_id % 10 AS INT) AS subject, count(*) AS n_trials, 4 AS min_channels,
       4 AS max_channels, 16 AS min_samples, 16 AS max_samples,
       count(*) FILTER (label % 4 = 0) AS class0, count(*) FILTER (label % 4 = 1) AS class1,
       count(*) FILTER (label % 4 = 2) AS class2, count(*) FILTER (label % 4 = 3) AS class3
       FROM embeddings GROUP BY 1""",
)
def profile_query(spark, sf_dir):
    return tr.profile_trials(v.trials(spark, sf_dir), range(4))


@query(
    "crop",
    f"""WITH {v.SQL_SAMPLES} SELECT trial, ch, CAST(t - 3 AS INT) AS t, round(v, 6) AS v
        FROM samples WHERE t >= 3""",
)
def crop_query(spark, sf_dir):
    """Samples 3..40 of 16: the end is clamped."""
    cut = v.trials(spark, sf_dir).withColumn("x", signals.crop(F.col("x"), 3, 40))
    return long_form(cut, ["trial"])


@query(
    "zscore_rows",
    f"""WITH {v.SQL_SAMPLES} SELECT trial, ch, t,
        round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 5) AS v FROM samples
        WINDOW w AS (PARTITION BY trial, ch)""",
)
def zscore_rows_query(spark, sf_dir):
    scaled = v.trials(spark, sf_dir).withColumn("x", signals.zscore_rows(F.col("x")))
    return long_form(scaled, ["trial"], 5)


@query(
    "zscore_subject",
    f"""WITH {v.SQL_SAMPLES} SELECT trial, ch, t,
        round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 5) AS v FROM samples
        WINDOW w AS (PARTITION BY subject, ch)""",
)
def zscore_subject_query(spark, sf_dir):
    return long_form(tr.zscore_subject(v.trials(spark, sf_dir)), ["trial"], 5)


@query(
    "zscore_subject_offset",
    f"""WITH {v.SQL_SAMPLES}, far AS (SELECT trial, subject, ch, t, floor(v * 1024) / 1024 + 1048576 AS v FROM samples)
        SELECT trial, ch, t, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 3) AS v FROM far
        WINDOW w AS (PARTITION BY subject, ch)""",
)
def zscore_offset_query(spark, sf_dir):
    """Signals a million times farther from zero than from each other, on a grid that sums exactly."""
    far = F.transform("x", lambda ch: F.transform(ch, lambda s: F.floor(s.cast("double") * 1024) / 1024 + 1048576.0))
    return long_form(tr.zscore_subject(v.trials(spark, sf_dir).withColumn("x", far)), ["trial"], 3)


@query(
    "sliding_windows",
    f"""WITH {v.SQL_WINDOWS} SELECT trial, y, CAST(start // 2 AS INT) AS w, start, ch,
        CAST(t AS INT) AS t, round(v, 6) AS v FROM windows""",
)
def windows_query(spark, sf_dir):
    windows = tr.sliding_windows(v.trials(spark, sf_dir), 8, 2)
    return long_form(windows, ["trial", "y", "w", "start"])


SQL_COV = f"""{v.SQL_WINDOWS},
centred AS (SELECT *, v - avg(v) OVER (PARTITION BY trial, start, ch) AS c FROM windows),
emp AS (SELECT a.trial, a.subject, a.start, a.ch AS i, b.ch AS j, sum(a.c * b.c) / 8 AS s
        FROM centred a JOIN centred b USING (trial, start, t) GROUP BY ALL),
shape AS (SELECT trial, start, sum(s) FILTER (i = j) / 4 AS mu, avg(s * s) AS a FROM emp
          GROUP BY trial, start),
rho AS (SELECT trial, start, mu, CASE WHEN a - mu * mu / 4 = 0 THEN 1 ELSE
        least(1, (a + mu * mu) / (9 * (a - mu * mu / 4))) END AS rho FROM shape),
cov AS (SELECT trial, subject, start, i, j,
        (1 - rho) * s + CASE WHEN i = j THEN rho * mu ELSE 0 END AS v
        FROM emp JOIN rho USING (trial, start))"""


def window_covs(spark, sf_dir):
    return tr.window_covariances(v.trials(spark, sf_dir), 8, 2)


@query(
    "window_covariance_oas",
    f"""WITH {SQL_COV} SELECT trial, CAST(start // 2 AS INT) AS w, i, j, round(v, 7) + 0.0 AS v
        FROM cov""",
)
def covariance_query(spark, sf_dir):
    return matrix_rows(window_covs(spark, sf_dir), ["trial", "w"], "cov", 7)


SQL_SECOND = f"""{v.SQL_SAMPLES}, second AS (SELECT a.trial, a.subject, a.ch AS i, b.ch AS j,
    sum(a.v * b.v) / 16 AS v FROM samples a JOIN samples b USING (trial, t) GROUP BY ALL)"""


@query(
    "second_moment",
    f"WITH {SQL_SECOND} SELECT trial, i, j, round(v, 7) + 0.0 AS v FROM second",
)
def second_moment_query(spark, sf_dir):
    return matrix_rows(
        tr.covariances(v.trials(spark, sf_dir), "second_moment"), ["trial"], "cov", 7
    )


@query(
    "subject_reference",
    f"""WITH {SQL_COV} SELECT subject, i, j, round(avg(v), 7) + 0.0 AS v FROM cov
        GROUP BY subject, i, j""",
)
def reference_query(spark, sf_dir):
    return matrix_rows(
        tr.subject_reference(window_covs(spark, sf_dir)), ["subject"], "ref", 7
    )


SQL_IDENTITY = """SELECT CAST(s AS INT) AS subject, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v
    FROM (SELECT DISTINCT vec_id % 10 AS s FROM embeddings),
    (SELECT CAST(unnest(range(0, 4)) AS INT) AS i), (SELECT CAST(unnest(range(0, 4)) AS INT) AS j)"""


@query("aligned_covariance_mean", SQL_IDENTITY)
def aligned_query(spark, sf_dir):
    """After alignment the mean matrix of every subject is the identity."""
    aligned = tr.align_by_subject(window_covs(spark, sf_dir))
    return matrix_rows(tr.subject_reference(aligned), ["subject"], "ref")


@query("aligned_covariances")
def aligned_rows_query(spark, sf_dir):
    aligned = tr.align_by_subject(window_covs(spark, sf_dir))
    return matrix_rows(aligned, ["trial", "w"], "cov")


@query("whitened_second_moment", SQL_IDENTITY)
def whitened_query(spark, sf_dir):
    """Whitened trials have the identity as the subject's mean second moment."""
    trials = v.trials(spark, sf_dir)
    white = tr.whiten_by_subject(trials, tr.whitening_by_subject(trials))
    return matrix_rows(
        tr.subject_reference(tr.covariances(white, "second_moment")), ["subject"], "ref"
    )


@query(
    "whiten_with_given_matrix",
    f"""WITH {v.SQL_SAMPLES}, w AS (SELECT subject, ch, 1 / sqrt(avg(v * v)) AS d FROM samples
        GROUP BY subject, ch)
        SELECT trial, ch, t, round(v * d, 5) AS v FROM samples JOIN w USING (subject, ch)""",
)
def whiten_given_query(spark, sf_dir):
    """Whitening with a diagonal matrix handed in by the caller."""
    trials = v.trials(spark, sf_dir)
    channel = trials.select("subject", F.posexplode("x").alias("ch", "s")).select(
        "subject", "ch", F.explode("s").alias("v")
    )
    scale = channel.groupBy("subject", "ch").agg(
        (F.lit(1.0) / F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("d")
    )
    ordered = F.array_sort(F.collect_list(F.struct("ch", "d")))
    diagonal = F.flatten(
        F.transform(
            "e",
            lambda row: F.transform(
                "e", lambda col: F.when(col["ch"] == row["ch"], row["d"]).otherwise(F.lit(0.0))
            ),
        )
    )
    matrices = scale.groupBy("subject").agg(ordered.alias("e")).select(
        "subject", diagonal.alias("whitening")
    )
    return long_form(tr.whiten_by_subject(trials, matrices), ["trial"], 5)


SQL_TOKENS = """tok AS (SELECT vec_id AS id, i AS pos, j, embedding[i * 16 + j + 1]::DOUBLE AS v,
    CASE WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END AS mask
    FROM embeddings, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 16)) AS j))"""


@query(
    "pooled_token_vectors",
    f"""WITH {SQL_TOKENS}, m AS (SELECT id, j, max(v) FILTER (pos = 0) AS f,
        sum(v * mask) / greatest(sum(mask), 1) AS a FROM tok GROUP BY id, j)
        SELECT id, CAST(j AS INT) AS j, round(f, 6) AS v FROM m UNION ALL
        SELECT id, CAST(j + 16 AS INT), round(a, 6) FROM m""",
)
def pooled_query(spark, sf_dir):
    """Rows of 16 numbers play the token vectors of a text."""
    tokens = (
        v.trials(spark, sf_dir)
        .select(F.col("trial").alias("id"), F.posexplode("x").alias("pos", "vector"))
        .withColumn("mask", F.when((F.col("id") + F.col("pos")) % 3 == 0, 0).otherwise(1))
    )
    pooled = tr.pooled_token_vectors(tokens)
    return pooled.select("id", F.posexplode("pooled").alias("j", "v")).withColumn(
        "v", F.round("v", 6)
    )



@query("filter_signals")
def filter_query(spark, sf_dir):
    """Two channels of 32 samples at 250 Hz: notch, band-pass, crop."""
    out = tr.filter_signals(v.trials(spark, sf_dir, channels=2), band_without_hum(8.0, 30.0, 250.0))
    out = out.withColumn("x", signals.crop(F.col("x"), 2, 30))
    return long_form(out, ["trial"])


RECORDING_DESIGN = butter_bandpass(1, 20.0, 100.0, 250.0)
RECORDING_TAPS = 64  # the design's response has shrunk below 1e-15 of its start by then


def _sql_recordings() -> str:
    """Both directions as sums over the impulse response.

    A filter that starts in its steady state acts as if the first sample had always been there,
    so places before the first sample read that sample.
    """
    pulse = np.zeros((1, RECORDING_TAPS))
    pulse[0, 0] = 1.0
    b, a = RECORDING_DESIGN
    taps = run_filter(b, a, pulse, np.zeros((1, len(a) - 1)))[0]
    pad = 3 * len(a)
    gain = float(sum(b) / sum(a))
    return f"""WITH h AS (SELECT unnest(range(0, {RECORDING_TAPS})) AS k, unnest({taps.tolist()}::DOUBLE[]) AS w),
    cells AS (SELECT vec_id % 10 AS subject, vec_id // 10 * 64 + unnest(range(0, 64)) AS t,
                     unnest(embedding)::DOUBLE AS v FROM embeddings),
    ends AS (SELECT subject, min(t) AS lo, max(t) AS hi, arg_min(v, t) AS v_lo, arg_max(v, t) AS v_hi FROM cells GROUP BY ALL),
    wide AS (SELECT subject, t, v FROM cells
      UNION ALL SELECT subject, 2 * lo - t, 2 * v_lo - v FROM cells JOIN ends USING (subject) WHERE t > lo AND t <= lo + {pad}
      UNION ALL SELECT subject, 2 * hi - t, 2 * v_hi - v FROM cells JOIN ends USING (subject) WHERE t < hi AND t >= hi - {pad}),
    forth_rest AS (SELECT subject, min(t) AS edge, arg_min(v, t) AS c FROM wide GROUP BY subject),
    forth AS (SELECT w.subject, w.t + h.k AS t, sum(h.w * (w.v - r.c)) AS y
      FROM wide w JOIN forth_rest r USING (subject), h GROUP BY w.subject, w.t + h.k),
    there AS (SELECT w.subject, w.t, f.y + r.c * {gain!r}::DOUBLE AS v
      FROM wide w JOIN forth f USING (subject, t) JOIN forth_rest r USING (subject)),
    back_rest AS (SELECT subject, max(t) AS edge, arg_max(v, t) AS c FROM there GROUP BY subject),
    back AS (SELECT w.subject, w.t - h.k AS t, sum(h.w * (w.v - r.c)) AS y
      FROM there w JOIN back_rest r USING (subject), h GROUP BY w.subject, w.t - h.k)
    SELECT c.subject, c.t, round(b.y + r.c * {gain!r}::DOUBLE, 6) AS v
    FROM cells c JOIN back b USING (subject, t) JOIN back_rest r USING (subject)"""


@query("filter_recordings", _sql_recordings())
def recordings_query(spark, sf_dir):
    """The vectors of ten subjects as consecutive chunks of ten long recordings, band-passed."""
    vec = F.col("vec_id")
    chunks = v.table(spark, sf_dir, "embeddings").select(
        (vec % 10).alias("subject"),
        (F.floor(vec / 10) * 64).cast("long").alias("start"),
        F.array(F.col("embedding").cast("array<double>")).alias("x"),
    )
    out = filter_recordings(chunks, [RECORDING_DESIGN], ["subject"])
    samples = out.select("subject", "start", F.posexplode(F.get("x", 0)).alias("i", "v"))
    return samples.select("subject", (F.col("start") + F.col("i")).alias("t"), F.round("v", 6).alias("v"))


SQL_WINDOW_SCORES = f"""{v.SQL_WINDOWS},
feat AS (SELECT trial, y, start, ch, avg(v) AS f FROM windows GROUP BY ALL),
cent AS (SELECT y AS cls, ch, avg(f) AS c FROM feat GROUP BY ALL),
z AS (SELECT trial, f.y, start, cls, -100 * sum((f - c) * (f - c)) AS z FROM feat f JOIN cent USING (ch)
      GROUP BY ALL),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY trial, start)) AS e FROM z),
p AS (SELECT trial, y, start, cls, e / sum(e) OVER (PARTITION BY trial, start) AS p FROM e)"""


@query(
    "soft_vote_windows",
    f"""WITH {SQL_WINDOW_SCORES}, voted AS (SELECT trial, y, cls, avg(p) AS p FROM p GROUP BY ALL)
    SELECT trial, y, CAST(arg_max(cls, (p, -cls)) AS INT) AS label, round(max(p), 6) AS top,
           5::BIGINT AS n_windows FROM voted GROUP BY trial, y""",
)
def soft_vote_windows_query(spark, sf_dir):
    """Channel means of each window against class centroids, averaged over the windows."""
    import json

    from turnspark.functions.binding import bind
    from turnspark.functions.scores import array_sum, softmax
    from turnspark.operators.ensemble import soft_vote

    windows = tr.sliding_windows(v.trials(spark, sf_dir), 8, 2)
    features = windows.select(
        "trial", "y", F.transform("x", lambda ch: signals.mean_of(ch)).alias("f")
    )
    found = (
        features.groupBy("y")
        .agg(*[F.avg(F.get("f", c)).alias(f"c{c}") for c in range(CHANNELS)])
        .orderBy("y")
        .collect()
    )
    centroids = F.from_json(
        F.lit(json.dumps([list(r[1:]) for r in found])), "array<array<double>>"
    )
    scores = bind(
        F.col("f"),
        lambda f: F.transform(
            centroids,
            lambda c: F.lit(-100.0) * array_sum(F.zip_with(f, c, lambda a, b: (a - b) * (a - b))),
        ),
    )
    probs = features.select("trial", "y", softmax(scores).alias("probs"))
    voted = soft_vote(probs, ["trial", "y"], 4)
    return voted.select(
        "trial", "y", "label", F.round(F.array_max("probs"), 6).alias("top"), "n_windows"
    )
