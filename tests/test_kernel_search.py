"""Scores of kernel ridges that share their sums, against fits one by one."""

import numpy as np
import pytest

from skylattice.learn import evaluate, kernel_search, kernels, vector_search
from skylattice.learn.evaluate import Part, Setting
from skylattice.learn.regressors import monomials, regressor

SETTING = Setting(key=("k",), target="z", preprocessing="drop", weight="w")
POINTS = [{"alpha": a, "gamma": g, "degree": d, "coef0": c} for a, g, d, c in (
    (0.6, 0.2, 1, 1.0), (0.1, 2.0, 3, 2.5), (0.3, None, 3, 1.0), (0.2, 0.1, 5, 1.0), (0.5, 0.3, 9, 1.0), (0.4, 0.1, 7, 1.0))]


def frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    z = 0.5 + 0.05 * np.sin(x[:, 0]) + 0.03 * x[:, 1] * x[:, 2]
    rows = [(i, float(rng.uniform(0.5, 2)) if i % 9 else None, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "k long, w double, " + ", ".join(f"c{i} double" for i in range(8)) + ", z double")


def test_products_are_spark_s_monomials():
    x = np.random.default_rng(0).normal(size=(6, 3))
    powers = monomials(3, 4)
    got = kernel_search._products(x, powers)
    assert np.allclose(got[:, 0], 1) and all(np.allclose(got[:, k], np.prod(x ** np.array(p), axis=1)) for k, p in enumerate(powers, 1))


def test_shared_sums_score_as_single_fits(spark, monkeypatch):
    """Primal and landmark degrees, weighted rows: one pass of sums for all primal points, one for a group of others."""
    part = Part(0, "drop", frame(spark, 300, 1), frame(spark, 90, 2))
    base = regressor("KRR")
    tried = [base.with_params(**p) for p in POINTS]
    expected, _ = evaluate._scored([evaluate._fit(c, part, SETTING).table for c in tried], SETTING)
    passes, sums = [], kernels._sums
    monkeypatch.setattr(kernels, "_sums", lambda *a: passes.append(a[1]) or sums(*a))
    got = evaluate.score_candidates(tried, part, SETTING)
    # degree 5 of eight inputs is too wide for the primal form
    assert len(passes) == 2 and passes[0] == len(monomials(8, 3)) + 1
    for (s, chosen), e in zip(got, expected):
        assert (s.sigma, s.eta, s.bias, s.rows) == pytest.approx((e.sigma, e.eta, e.bias, e.rows), rel=1e-6)
        assert chosen == s.score


VECTORS = [{"C": c, "gamma": g, "landmarks": 400} for c, g in ((1.0, 0.1), (3.0, 2.0), (0.5, 40.0), (2.0, 9000.0))]


def test_searched_vectors_score_as_single_fits(spark, monkeypatch):
    """Weighted rows, kernels that reach all rows and kernels that reach next to none; larger tables go one by one."""
    part = Part(0, "drop", frame(spark, 300, 1), frame(spark, 90, 2))
    base = regressor("SVR")
    tried = [base.with_params(**p, epsilon=0.01) for p in VECTORS]
    expected, _ = evaluate._scored([evaluate._fit(c, part, SETTING).table for c in tried], SETTING)
    got = evaluate.score_candidates(tried, part, SETTING)
    for (s, chosen), e in zip(got, expected):
        # either fit is within the gap of the optimum
        assert (s.sigma, s.eta, s.bias) == pytest.approx((e.sigma, e.eta, e.bias), abs=2e-3) and s.rows == e.rows
        assert chosen == s.score
    monkeypatch.setattr(vector_search, "SHARED_BYTES", 300 * 80 - 1)
    assert vector_search.scores(VECTORS, "standard", part.train, part.test, [f"c{i}" for i in range(8)], "z", "w") is None


def test_held_rows_leave_out_only_noughts():
    """Rows far from all landmarks keep no column; with or without a kept map the answer is the same."""
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(400, 3)), rng.uniform(0.5, 2, 400)
    y = np.sin(x[:, 0]) + 0.1 * rng.normal(size=400)
    mapped = kernels.map_of(x[:60], kernels.Kernel("rbf", 3000.0))
    found = []
    for most in (kernels.HeldRows.KEPT, -1):
        kernels.HeldRows.KEPT, before = most, kernels.HeldRows.KEPT
        rows = kernels.HeldRows(x, y, w, mapped)
        kernels.HeldRows.KEPT = before
        assert sum(len(b) for _, b, _ in rows.parts()) == 400
        found.append(kernels.support_vectors(rows, mapped, 1.0, 0.05))
        assert found[-1].gap <= kernels.GAP * found[-1].objective
    kept = kernels.HeldRows(x, y, w, mapped).kept
    assert kept[-1][0].shape[1] == 0 and len(kept[-1][0]) > 100
    assert found[0].objective == pytest.approx(found[1].objective, rel=1e-3)


def test_the_registered_search_of_vectors_is_whole():
    from checks import learning

    closure = dict(zip(learning.QUERIES["guided_search_svr"].__code__.co_freevars, (c.cell_contents for c in learning.QUERIES["guided_search_svr"].__closure__)))
    assert closure["evals"] == 200 and closure["points"] is None
