"""Landmark kernels against the exact problems on small tables."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from skylattice.learn import kernels, search
from skylattice.learn.evaluate import Setting, fit_predict, holdout_parts
from skylattice.learn.regressors import regressor
from skylattice.session import staging

SETTING = Setting(key=("k",), target="z", preprocessing="drop", cv=2, parallelism=2)


def data(n=120, p=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(size=n) * 0.05, rng.uniform(0.3, 2.0, n)


def frame(spark, x, y, w):
    return spark.createDataFrame([(Vectors.dense(r.tolist()), float(a), float(b)) for r, a, b in zip(x, y, w)], ["features", "_label", "_weight"]).repartition(3)


def dual(k, y, c, epsilon, steps=60_000):
    """Exact dual by pairwise coordinate ascent: ``max y a - epsilon |a| - a K a / 2``, ``|a_i| <= c_i``, sum of a nought."""
    a, n = np.zeros(len(y)), len(y)
    ka, rng = np.zeros(n), np.random.default_rng(0)
    for _ in range(steps):
        up = y - ka - epsilon * np.where(a >= 0, 1, -1)
        down = y - ka - epsilon * np.where(a > 0, 1, -1)
        up[a >= c], down[a <= -c] = -np.inf, np.inf
        i, j = int(np.argmax(up)), int(np.argmin(down))
        if up[i] - down[j] < 1e-9:
            break
        t = min((up[i] - down[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), c[i] - a[i], c[j] + a[j])
        t = min(t, -a[i] if a[i] < 0 else np.inf, a[j] if a[j] > 0 else np.inf)
        a[i], a[j], ka = a[i] + t, a[j] - t, ka + t * (k[:, i] - k[:, j])
    value = y @ a - epsilon * np.abs(a).sum() - a @ ka / 2
    return a, value


@pytest.mark.parametrize("c,epsilon,weighted", [(1.0, 0.1, False), (10.0, 0.05, True), (0.1, 0.3, False)])
def test_support_vectors_reach_the_dual(spark, c, epsilon, weighted):
    """With every row a landmark the objective meets the dual's within the told gap, and the gap is small."""
    x, y, w = data()
    w = w if weighted else np.ones(len(y))
    table, kernel = frame(spark, x, y, w), kernels.Kernel("rbf", 0.5)
    mapped = kernels.landmark_map(table, kernel, 200)
    assert kernels.kernel_error(table, mapped) < 1e-6
    found = kernels.support_vectors(kernels.plain_rows(table), mapped, c, epsilon)
    a, value = dual(kernel(x, x), y, c * w, epsilon)
    assert found.gap <= kernels.GAP * found.objective * 1.001
    assert value * (1 - 1e-6) <= found.objective <= value + found.gap + 1e-6 * value
    guess = mapped.phi(x) @ found.coefficients + found.offset
    free = (np.abs(a) > 1e-6) & (np.abs(a) < c * w - 1e-6)
    offset = np.median((y - kernel(x, x) @ a - epsilon * np.sign(a))[free])
    assert np.abs(guess - (kernel(x, x) @ a + offset)).max() < 0.05


@pytest.mark.parametrize("c,epsilon,gamma", [(10.0, 0.05, 0.5), (10.0, 0.01, 5.0), (10.0, 0.01, 20.0)])
def test_support_vectors_take_few_passes(spark, monkeypatch, c, epsilon, gamma):
    """Narrow tubes and costly slacks end at the gap asked for, after a few passes over spread rows."""
    x, y, w = data()
    table, passes, sums = frame(spark, x, y, w).coalesce(1), [], kernels._sums
    monkeypatch.setattr(kernels, "_sums", lambda rows, *rest: passes.append(rows.rdd.getNumPartitions()) or sums(rows, *rest))
    mapped = kernels.landmark_map(table, kernels.Kernel("rbf", gamma), 200)
    with staging(spark) as stage:
        found = kernels.support_vectors(kernels.spread_rows(table, stage), mapped, c, epsilon)
    assert found.gap <= kernels.GAP * found.objective
    assert len(passes) <= 40 and min(passes) > 1


def test_few_landmarks_are_measured(spark):
    x, y, w = data(400)
    table, kernel = frame(spark, x, y, w), kernels.Kernel("rbf", 0.2)
    errors = [kernels.kernel_error(table, kernels.landmark_map(table, kernel, m)) for m in (5, 40, 200)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-4


@pytest.mark.parametrize("degree,inputs", [(9, 6), (7, 8)])
def test_wide_polynomials_equal_the_dual(spark, degree, inputs):
    x, y, w = data(100, inputs)
    gamma, alpha, coef0 = 1.0 / inputs, 0.7, 1.0
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"c{i} double" for i in range(inputs)) + ", z double")
    names = [f"c{i}" for i in range(inputs)]
    fitted = regressor("KRR").with_params(degree=degree, alpha=alpha, coef0=coef0).fit(df, names, "z")
    got = np.array([r["y_pred"] for r in fitted.predict(df).orderBy("k").collect()])
    s = (x - x.mean(0)) / x.std(0)
    k = (gamma * s @ s.T + coef0) ** degree
    assert np.abs(got - k @ np.linalg.solve(k + alpha * np.eye(100), y)).max() < 1e-3


def test_extreme_draws_end(spark):
    """The dearest draws of the search on ten features end with finite predictions."""
    x, y, _ = data(90, 10)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"c{i} double" for i in range(10)) + ", z double")
    draws = [p for p in search.candidates("KRR", search.GUIDED, 60) if p["degree"] in (7, 9)][:2] + [{"alpha": 1e-3, "gamma": 9999.0, "degree": 9, "coef0": 1.0}]
    part, test = holdout_parts(df, SETTING)
    for p in draws:
        out = fit_predict(regressor("KRR").with_params(**p), part, test, SETTING).table.collect()
        assert out and all(np.isfinite(r["y_pred"]) for r in out)
    out = fit_predict(regressor("SVR").with_params(C=20.0, gamma=9000.0), part, test, SETTING).table.collect()
    assert all(np.isfinite(r["y_pred"]) for r in out)


def test_no_rows(spark):
    table = frame(spark, *data(3)).limit(0)
    mapped = kernels.landmark_map(table, kernels.Kernel("rbf", 1.0))
    assert kernels.support_vectors(kernels.plain_rows(table), mapped, 1.0, 0.1).objective == 0
