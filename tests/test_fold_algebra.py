"""Cross-validation by sums of products against fits of their own, and grouped order statistics against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.learn import evaluate, fold_algebra, selection
from skylattice.learn.evaluate import BEST, SetValidator, Setting, fold_parts, validate_parts, with_folds
from skylattice.learn.regressors import regressor
from skylattice.operators import metrics, order_stats
from skylattice.plans import training
from skylattice.session import staging

SETTING = Setting(key=("k",), target="z", preprocessing="mean", cv=3, parallelism=2)
LASSO = regressor("LASSO").with_params(alpha=0.003, tol=1e-14, maxIter=3000)


def frame(spark, n=240, gaps=True, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)) * [1.0, 2.0, 0.5, 1.5] + [20.0, 21.0, 0.3, 22.0], 1)
    z = 0.5 + 0.3 * (x[:, 0] - 20) - 0.1 * (x[:, 1] - 21) + 0.05 * x[:, 3] * (x[:, 2] > 0.3) + rng.normal(size=n) * 0.02
    rows = [(i, *map(float, r), float(v), float(w)) for i, (r, v, w) in enumerate(zip(x, z, rng.uniform(0.2, 2.0, n)))]
    df = spark.createDataFrame(rows, "k bigint, r double, u double, `Gini index` double, i double, z double, w double")
    if not gaps:
        return df
    return df.withColumns({
        "u": F.when(F.col("k") % 11 == 0, F.lit(None)).when(F.col("k") % 13 == 0, -99.0).otherwise(F.col("u")),
        "i": F.when(F.col("k") % 9 == 0, float("nan")).otherwise(F.col("i")),
        "r": F.when(F.col("k") % 4 == 0, -10.0).otherwise(F.col("r")),  # too sparse: leaves every fit
        "z": F.when(F.col("k") % 50 == 7, F.lit(None)).otherwise(F.col("z"))})


def both(df, model, setting, columns):
    folded = with_folds(df, setting).persist()
    view = folded.select(*[c for c in (*setting.bookkeeping, setting.target) if c in folded.columns], *[f"`{c}`" for c in columns])
    assert evaluate.by_algebra(model, folded, columns, setting)
    own = validate_parts(model, fold_parts(view, setting), setting)
    with staging(df.sparkSession) as stage:
        got = SetValidator(model, folded, columns, setting, stage).validate([{c: c for c in columns}])[0]
    folded.unpersist()
    return own, got


def same(a, b, near=1e-6):
    assert a.preprocessing == b.preprocessing
    for name in ("sigma", "eta", "score", "total", "chosen"):
        assert getattr(a, name).mean == pytest.approx(getattr(b, name).mean, abs=near)
        assert getattr(a, name).error == pytest.approx(getattr(b, name).error, abs=near)


@pytest.mark.parametrize("method", ["drop", "mean", "mode", "median", 20.5, BEST])
def test_equals_fits_on_parts(spark, method):
    same(*both(frame(spark), LASSO, selection.with_setting(SETTING, preprocessing=method), ["r", "u", "Gini index", "i"]))


@pytest.mark.parametrize("name,weight,method", [("LASSO", "w", "mean"), ("ENET", None, "drop"), ("ENET", "w", None)])
def test_equals_weighted_fits_and_elastic_net(spark, name, weight, method):
    model = regressor(name).with_params(alpha=0.01, tol=1e-14, maxIter=3000)
    near = 1e-6 if name == "LASSO" else 1e-5  # the iterative fit ends this close
    same(*both(frame(spark, gaps=method is not None), model, selection.with_setting(SETTING, weight=weight, preprocessing=method), ["u", "Gini index", "i"]), near)


def test_standard_scaling(spark):
    model = selection.replace(LASSO, scaling="standard")
    same(*both(frame(spark), model, SETTING, ["u", "Gini index", "i"]))


def test_gaps_that_nobody_fills(spark):
    df = with_folds(frame(spark), SETTING)
    with staging(spark) as stage, pytest.raises(ValueError, match="missing values remain"):
        SetValidator(LASSO, df, ["u"], selection.with_setting(SETTING, preprocessing=None), stage).validate([{"u": "u"}])


@pytest.mark.parametrize("alpha,l1", [(0.0, 1.0), (0.01, 1.0), (0.3, 0.5), (0.1, 0.0), (50.0, 1.0)])
def test_descent_meets_the_optimality_conditions(alpha, l1):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    y = x @ [1, 0, -2, 0, 0.5, 0] + rng.normal(size=80)
    c, r = np.cov(x.T, bias=True), (x - x.mean(0)).T @ (y - y.mean()) / 80
    b = fold_algebra.elastic_net(c, r, alpha, l1)
    slope = c @ b - r + alpha * (1 - l1) * b
    assert np.abs(slope[b != 0] + alpha * l1 * np.sign(b[b != 0])).max(initial=0) < 1e-9
    assert (np.abs(slope[b == 0]) <= alpha * l1 + 1e-9).all()
    assert (b == 0).all() if alpha == 50.0 else True


def test_columns_without_spread_or_copies():
    c = np.array([[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    for alpha in (0.0, 0.1):
        b = fold_algebra.elastic_net(c, np.array([1.0, 1.0, 0.0]), alpha, 1.0)
        assert b[0] + b[1] == pytest.approx(1 - alpha) and b[2] == 0


def test_importance_and_gain_equal_fits_of_their_own(spark, monkeypatch):
    df = frame(spark, 160).drop("r").withColumn("u", F.abs("u"))
    run = lambda: (
        selection.permutation_importance(LASSO, df.drop("w"), SETTING),
        selection.eliminate_features(LASSO, df.drop("w"), SETTING)[1],
        selection.morphology_gain(LASSO, df.drop("w"), SETTING, bands=("u", "i"), features=("Gini index",)))
    fast = run()
    monkeypatch.setattr(evaluate, "by_algebra", lambda *_: False)
    slow = run()
    assert [f["Feature"] for f in fast[0]] == [f["Feature"] for f in slow[0]] and fast[1] == slow[1]
    assert [f["score"] for f in fast[0]] == pytest.approx([f["score"] for f in slow[0]], abs=1e-6)
    assert {f["bands"]: f["score"] for f in fast[2]} == pytest.approx({f["bands"]: f["score"] for f in slow[2]}, abs=1e-6)


def test_all_orders_share_their_passes(spark, monkeypatch):
    """25 sets cost as many jobs as 3, and each equals its own validation."""
    df = frame(spark, 160).drop("w").drop("Gini index")
    jobs = []
    for bands in (["u", "i"], ["u", "i", "r", "g"]):
        variants = training.folded_feature_sets(df.withColumn("g", F.col("k") % 17 / 3.0), SETTING, bands)
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        _, found = selection.select_features(LASSO, variants, SETTING)
        jobs.append(len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)))
    assert len(found) == 25 and jobs[1] <= jobs[0] + 6
    for k in (0, 1, 17, 24):
        assert found[k].chosen.mean == pytest.approx(validate_parts(LASSO, fold_parts(variants[k], SETTING), SETTING).chosen.mean, abs=1e-6)


def test_grouped_order_statistics(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=301), 1: np.array([5.0]), 2: np.repeat([1.0, 2.0], 50), 3: rng.normal(size=400) * 1e200, 4: np.round(rng.normal(size=200), 1)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double")
    counts = {g: len(v) for g, v in groups.items()}
    assert order_stats.grouped_medians(df, "g", "x", counts) == {g: pytest.approx(np.median(v)) for g, v in groups.items()}
    got = order_stats.grouped_quantiles(df, "g", "x", (0.25, 0.75), counts)
    assert got == {g: pytest.approx(list(np.quantile(v, [0.25, 0.75]))) for g, v in groups.items()}
    with pytest.raises(ValueError):
        order_stats.grouped_order_statistics(df, "g", "x", {9: [0]})


def test_grouped_scores_equal_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(d)) for g, d in zip(rng.integers(0, 3, 500), rng.normal(size=500) * 0.2)]
    df = spark.createDataFrame(rows, "g int, dz double")
    got = metrics.grouped_scores(df, "g", "dz", 3)
    truth = df.select("g", F.lit(0.0).alias("y_test"), (-F.col("dz")).alias("y_pred"))
    expected = metrics.scores_by(truth, "g", [0, 1, 2])
    for g in range(3):
        assert (got[g].sigma, got[g].eta, got[g].bias) == pytest.approx((expected[g].sigma, expected[g].eta, expected[g].bias))
    with pytest.raises(ValueError):
        metrics.grouped_scores(df, "g", "dz", 4)
