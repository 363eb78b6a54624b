"""Signals, alignment and estimators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspark.functions import filters, signals
from turnspark.models import linear, riemann, spatial
from turnspark.operators import trials as tr
from turnspark.plans import alignment as al

RNG = np.random.default_rng(0)
X = RNG.normal(size=(24, 3, 40)) * np.array([1.0, 2.0, 0.5])[None, :, None]
Y = np.arange(24) % 3
SUBJECT = np.arange(24) % 4
X = X + 0.4 * Y[:, None, None] * np.sin(np.arange(40) / 3.0)[None, None, :]


@pytest.fixture(scope="module")
def trials(spark):
    rows = [
        (int(SUBJECT[i]), i, int(Y[i]), X[i].tolist()) for i in range(len(X))
    ]
    df = spark.createDataFrame(rows, "subject int, trial long, y int, x array<array<double>>")
    return df.repartition(3).cache()


def arrays(df, column, keys):
    return {tuple(r[k] for k in keys): np.array(r[column]) for r in df.collect()}


def oas(x):
    c = x - x.mean(axis=1, keepdims=True)
    s, p, n = c @ c.T / x.shape[1], len(x), x.shape[1]
    mu, a = np.trace(s) / p, (s**2).mean()
    rho = min(1.0, (a + mu**2) / ((n + 1) * (a - mu**2 / p)))
    return (1 - rho) * s + rho * mu * np.eye(p)


def test_windows(spark, trials):
    assert signals.window_starts(16, 8, 2) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        signals.window_starts(7, 8, 2)
    got = arrays(tr.sliding_windows(trials, 20, 10), "x", ["trial", "w"])
    assert len(got) == 24 * 3
    np.testing.assert_allclose(got[(5, 2)], X[5][:, 20:40])
    with pytest.raises(Exception, match="longer than the trial"):
        tr.sliding_windows(trials, 41, 1).collect()


def test_crop(spark):
    df = spark.createDataFrame([([list(map(float, range(500)))],)], "x array<array<double>>")
    got = df.select(signals.crop(F.col("x"), 125, 875).alias("x")).first()["x"][0]
    assert got[0] == 125.0 and len(got) == 375
    one = df.select(signals.crop(F.col("x"), 600, 900).alias("x")).first()["x"][0]
    assert len(one) <= 1


def test_covariances(trials):
    fused = arrays(tr.window_covariances(trials, 20, 10), "cov", ["trial", "w"])
    plain = arrays(tr.covariances(tr.sliding_windows(trials, 20, 10)), "cov", ["trial", "w"])
    for (t, w), flat in fused.items():
        want = oas(X[t][:, 10 * w : 10 * w + 20]).reshape(-1)
        np.testing.assert_allclose(flat, want, atol=1e-12)
        np.testing.assert_allclose(plain[(t, w)], want, atol=1e-12)


def test_mixed_lengths(spark):
    rows = [(1, 0, [[1.0, 2.0, 4.0]]), (1, 1, [[1.0, 5.0]]), (1, 2, [[2.0, 2.0], [1.0, 3.0]])]
    df = spark.createDataFrame(rows, "subject int, trial long, x array<array<double>>").coalesce(1)
    got = arrays(tr.covariances(df, "second_moment"), "cov", ["trial"])
    assert got[(0,)].tolist() == [7.0] and got[(1,)].tolist() == [13.0]
    assert got[(2,)].tolist() == [4.0, 4.0, 4.0, 5.0]


def test_alignment_gives_identity(trials):
    aligned = tr.align_by_subject(tr.window_covariances(trials, 20, 10))
    for ref in arrays(tr.subject_reference(aligned), "ref", ["subject"]).values():
        np.testing.assert_allclose(ref.reshape(3, 3), np.eye(3), atol=1e-8)
    white = tr.whiten_by_subject(trials, tr.whitening_by_subject(trials))
    moments = tr.subject_reference(tr.covariances(white, "second_moment"))
    for ref in arrays(moments, "ref", ["subject"]).values():
        np.testing.assert_allclose(ref.reshape(3, 3), np.eye(3), atol=1e-8)


def test_zscores(trials):
    got = arrays(trials.withColumn("x", signals.zscore_rows(F.col("x"))), "x", ["trial"])
    want = (X[3] - X[3].mean(axis=1, keepdims=True)) / (X[3].std(axis=1, keepdims=True) + 1e-6)
    np.testing.assert_allclose(got[(3,)], want, atol=1e-9)
    got = arrays(tr.zscore_subject(trials), "x", ["trial"])
    own = X[SUBJECT == SUBJECT[3]]
    want = (X[3] - own.mean(axis=(0, 2))[:, None]) / (own.std(axis=(0, 2))[:, None] + 1e-6)
    np.testing.assert_allclose(got[(3,)], want, atol=1e-9)


def direct(b, a, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k)
        y[n] -= sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    return y


def test_filter_recursion_and_gain():
    b, a = filters.butter_bandpass(4, 8, 30, 250.0)
    x = RNG.normal(size=(2, 60))
    zero = np.zeros((2, len(a) - 1))
    np.testing.assert_allclose(filters.run_filter(b, a, x, zero)[1], direct(b, a, x[1]), atol=1e-8)

    def gain(b, a, hz):
        z = np.exp(-2j * np.pi * hz / 250.0)
        return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))

    assert gain(b, a, 15.5) == pytest.approx(1.0, abs=1e-3)
    assert gain(b, a, 8) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert gain(b, a, 30) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert gain(b, a, 1) < 1e-3 and gain(b, a, 90) < 1e-2
    nb, na = filters.notch(50, 250.0)
    assert gain(nb, na, 50) < 1e-9 and gain(nb, na, 20) == pytest.approx(1.0, abs=1e-2)
    with pytest.raises(ValueError):
        filters.zero_phase(b, a, np.zeros((1, 27)))


def test_filter_job_keeps_band(spark):
    t = np.arange(1125) / 250.0
    mix = [np.sin(2 * np.pi * hz * t) for hz in (2, 15, 50)]
    df = spark.createDataFrame([(0, 0, [sum(mix).tolist()])], "subject int, trial long, x array<array<double>>")
    out = np.array(tr.filter_signals(df, filters.band_without_hum(8.0, 30.0, 250.0)).first()["x"][0])
    assert len(out) == 1125
    np.testing.assert_allclose(out[125:875], mix[1][125:875], atol=0.02)


def test_zscore_subject_far_from_zero(spark):
    rng = np.random.default_rng(5)
    x = 1e8 + 0.001 * rng.standard_normal((4, 2, 16))
    rows = [(0, i, x[i].tolist()) for i in range(4)] + [(1, 9, x[0, :, :5].tolist())]
    df = spark.createDataFrame(rows, "subject int, trial long, x array<array<double>>")
    out = {r["trial"]: np.array(r["x"]) for r in tr.zscore_subject(df).collect()}
    mean, sd = x.mean(axis=(0, 2), keepdims=True), x.std(axis=(0, 2), keepdims=True)
    np.testing.assert_allclose(np.stack([out[i] for i in range(4)]), (x - mean) / (sd + 1e-6), atol=1e-3)


def logm(c):
    v, u = np.linalg.eigh(c)
    return (u * np.log(v)) @ u.T


def power(c, p):
    v, u = np.linalg.eigh(c)
    return (u * v**p) @ u.T


def test_karcher_and_tangent(trials):
    covs = tr.window_covariances(trials, 20, 10)
    mean = riemann.karcher_mean(covs)
    matrices = [c.reshape(3, 3) for c in arrays(covs, "cov", ["trial", "w"]).values()]
    root = power(mean, -0.5)
    total = sum(logm(root @ c @ root) for c in matrices)
    assert np.abs(total).max() < 1e-6
    got = arrays(riemann.tangent_features(covs, mean), "features", ["trial", "w"])
    c = arrays(covs, "cov", ["trial", "w"])[(7, 1)].reshape(3, 3)
    log = logm(root @ c @ root)
    want = [log[0, 0], 2**0.5 * log[0, 1], 2**0.5 * log[0, 2], log[1, 1], 2**0.5 * log[1, 2], log[2, 2]]
    np.testing.assert_allclose(got[(7, 1)], want, atol=1e-9)


def test_held_out_means_ignore_their_fold(trials):
    covs = tr.window_covariances(trials, 20, 20)
    all_folds = riemann.karcher_means(covs, "y", range(3), "subject", range(4))
    alone = riemann.karcher_means(covs.where("subject <> 2"), "y", range(3))
    for c in "012":
        np.testing.assert_allclose(all_folds[("2", c)], alone[("*", c)], atol=1e-7)
    voted = al.leave_one_subject_out_mdm(trials, 20, 20, range(3), range(4)).collect()
    assert len(voted) == 24
    assert all(sum(r["probs"]) == pytest.approx(1.0) for r in voted)


def test_joint_diagonalizer_and_csp():
    mix = RNG.normal(size=(4, 4))
    stack = np.array([mix @ np.diag(RNG.uniform(0.5, 3, 4)) @ mix.T for _ in range(3)])
    v = spatial.joint_diagonalizer(stack)
    for c in stack:
        d = v @ c @ v.T
        assert np.abs(d - np.diag(np.diag(d))).max() < 1e-6 * np.abs(d).max()
    rows = spatial.csp_filters({0: stack[0], 1: stack[1]}, {0: 0.5, 1: 0.5}, 4)
    total = rows @ (stack[0] + stack[1]) @ rows.T
    np.testing.assert_allclose(total, np.eye(4), atol=1e-8)


def brute_ledoit(z):
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p, d2)
    return (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)


def wide(spark, n=60, p=5):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + y[:, None]
    rows = [(i, int(a), r.tolist()) for i, (a, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(4), x, y


def test_lda_matches_numpy(spark):
    df, x, y = wide(spark)
    model = linear.fit_lda(df)
    within, means, priors = np.zeros((5, 5)), [], []
    for c in range(3):
        part = x[y == c]
        sd = part.std(axis=0)
        z = (part - part.mean(axis=0)) / sd
        within += len(part) / len(x) * (sd[:, None] * brute_ledoit(z) * sd)
        means.append(part.mean(axis=0))
        priors.append(len(part) / len(x))
    coef = np.linalg.solve(within, np.array(means).T).T
    np.testing.assert_allclose(model.coef, coef, atol=1e-8)
    np.testing.assert_allclose(
        model.intercept, -0.5 * (np.array(means) * coef).sum(axis=1) + np.log(priors), atol=1e-8
    )


def test_ridge_leave_one_out(spark):
    df, x, y = wide(spark, 40)
    model = linear.fit_ridge(df)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)

    def fit(zz, tt, alpha):
        m, b = zz.mean(axis=0), tt.mean(axis=0)
        w = np.linalg.solve((zz - m).T @ (zz - m) + alpha * np.eye(5), (zz - m).T @ (tt - b))
        return w, b - m @ w

    losses = []
    for alpha in linear.RIDGE_ALPHAS:
        wrong = 0.0
        for i in range(len(z)):
            keep = np.arange(len(z)) != i
            w, b = fit(z[keep], target[keep], alpha)
            wrong += ((target[i] - z[i] @ w - b) ** 2).sum()
        losses.append(wrong / target.size)
    np.testing.assert_allclose(model.info["loo"], losses, rtol=1e-8)
    w, b = fit(z, target, model.info["alpha"])
    got = arrays(model.decide(df), "scores", ["id"])
    np.testing.assert_allclose(got[(3,)], z[3] @ w + b, atol=1e-8)


def test_xdawn_and_composites(trials):
    windows = tr.sliding_windows(trials, 20, 20)
    model = spatial.fit_xdawn(windows, "y", 2)
    assert model.filters.shape == (6, 3) and model.prototypes.shape == (6, 20)
    cut = np.concatenate([X[Y == 1][:, :, s : s + 20] for s in (0, 20)])
    np.testing.assert_allclose(model.prototypes[2:4], model.filters[2:4] @ cut.mean(axis=0), atol=1e-8)
    covs = arrays(spatial.xdawn_covariances(windows, model), "cov", ["trial", "w"])
    assert covs[(0, 0)].shape == (144,)
    train, valid = trials.where("subject <> 3"), trials.where("subject = 3")
    for voted in (
        al.align_and_classify(train, valid, 20, 10, 3),
        al.vote(al.csp_lda_probs(train, valid, 20, 10, 2), 3),
        al.csp_ridge_votes(train, valid, 20, 10, 2),
    ):
        rows = voted.collect()
        assert len(rows) == 6 and all(0 <= r["pred"] < 3 for r in rows)


def test_signal_windows_hook(trials):
    def score(windows):
        return windows.withColumn("probs", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))).drop("x")

    rows = al.signal_windows(trials, 20, 10, score, 3).collect()
    assert len(rows) == 24 and {r["pred"] for r in rows} == {1}
    assert {r["n_windows"] for r in rows} == {3}


def test_pooled_tokens(spark):
    rows = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "id long, pos int, vector array<double>, mask int")
    got = {r["id"]: r["pooled"] for r in tr.pooled_token_vectors(df).collect()}
    assert got == {1: [1.0, 2.0, 2.0, 3.0], 2: [5.0, 5.0, 0.0, 0.0]}
