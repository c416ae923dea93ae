"""Regressors against plain computations; selection and search on small tables."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skylattice.config import SurveyConfig
from skylattice.learn import search, selection
from skylattice.learn.evaluate import (
    BEST, Setting, _fit, _scored, cross_validate, fit_predict, fold_parts, holdout_parts, score_candidates, with_folds)
from skylattice.learn.features import assemble, feature_columns
from skylattice.learn.regressors import REGRESSORS, monomials, regressor
from skylattice.plans import training

SETTING = Setting(key=("k",), target="z", preprocessing="drop", cv=2, parallelism=2)


def table(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 2.0, 0.5] + [20.0, 21.0, 0.3]
    z = 0.5 + 0.3 * (x[:, 0] - 20) - 0.1 * (x[:, 1] - 21) + 0.02 * (x[:, 0] - 20) ** 2 + rng.normal(size=n) * 0.02
    return x, z, rng.uniform(0.2, 2.0, n)


def frame(spark, x, z, w=None):
    rows = [(i, *map(float, r), float(v), *([float(w[i])] if w is not None else [])) for i, (r, v) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "k bigint, r double, u double, `Gini index` double, z double" + (", w double" if w is not None else ""))


def predicted(fitted, df):
    return np.array([r["y_pred"] for r in fitted.predict(df).orderBy("k").collect()])


def robust(x):
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    return (x - q2) / (q3 - q1)


def elastic_net(x, y, w, alpha, l1, rounds=4000):
    """Coordinate descent for 1/(2 sum w) sum w (y - xb - c)^2 + alpha (l1 |b| + (1 - l1)/2 b^2)."""
    w = w / w.sum()
    xc, yc = x - w @ x, y - w @ y
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(b)):
            rest = yc - xc @ b + xc[:, j] * b[j]
            rho = w @ (xc[:, j] * rest)
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (w @ xc[:, j] ** 2 + alpha * (1 - l1))
    return x @ b + w @ y - (w @ x) @ b


@pytest.mark.parametrize("name,weighted", [("LASSO", False), ("LASSO", True), ("ENET", True)])
def test_linear_models_equal_coordinate_descent(spark, name, weighted):
    x, z, w = table()
    alpha = 0.01
    df = frame(spark, x, z, w)
    fitted = regressor(name).with_params(alpha=alpha).fit(df, ["r", "u", "Gini index"], "z", "w" if weighted else None)
    expected = elastic_net(robust(x), z, w if weighted else np.ones(len(z)), alpha, REGRESSORS[name].params["l1_ratio"])
    assert np.abs(predicted(fitted, df) - expected).max() < 1e-3


@pytest.mark.parametrize("degree,weighted", [(2, False), (2, True), (3, False)])
def test_kernel_ridge_equals_its_dual_form(spark, degree, weighted):
    x, z, w = table(120)
    df = frame(spark, x, z, w)
    fitted = regressor("KRR").with_params(degree=degree).fit(df, ["r", "u", "Gini index"], "z", "w" if weighted else None)
    s = (x - x.mean(0)) / x.std(0)
    root = np.sqrt(w) if weighted else np.ones(len(z))
    k = (s @ s.T / 3 + 2.5) ** degree
    dual = np.linalg.solve(k * np.outer(root, root) + 0.6 * np.eye(len(z)), root * z)
    assert np.abs(predicted(fitted, df) - k @ (root * dual)).max() < 1e-7


def test_monomials_follow_the_expansion(spark):
    df = assemble(["a", "b", "c"]).transform(spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double"))
    out = PolynomialExpansion(degree=3, inputCol="features", outputCol="p").transform(df)
    got = out.select(vector_to_array("p").alias("p")).first()["p"]
    assert got == pytest.approx([2.0**a * 3.0**b * 5.0**c for a, b, c in monomials(3, 3)])


SMALL = {"RF": {"numTrees": 10, "maxDepth": 6}, "GBR": {"maxIter": 15}, "XGB": {"maxIter": 10}, "LGB": {"maxIter": 15, "stepSize": 0.3},
         "LASSO": {}, "ENET": {}, "KRR": {}, "SVR": {"C": 10.0}}


@pytest.mark.parametrize("name", list(REGRESSORS))
def test_every_regressor_learns(spark, name):
    x, z, _ = table()
    a, b = holdout_parts(frame(spark, x, z), SETTING)
    out = fit_predict(regressor(name).with_params(**SMALL[name]), a, b, SETTING)
    rows = out.table.collect()
    truth, guess = np.array([r["y_test"] for r in rows]), np.array([r["y_pred"] for r in rows])
    assert len(rows) == b.count() and out.table.columns == ["k", "y_test", "y_pred"]
    # a model that knows nothing leaves the variance of the target
    assert np.mean((truth - guess) ** 2) < 0.5 * truth.var()


def test_presets():
    assert REGRESSORS["RF"].params["numTrees"] == 86 and REGRESSORS["RF"].params["maxDepth"] == 11
    assert REGRESSORS["GBR"].params["maxIter"] == 3000 and REGRESSORS["XGB"].params["maxIter"] == 2200
    with pytest.raises(ValueError):
        regressor("other")


def test_rows_without_weight_do_not_count(spark):
    x, z, w = table(100)
    w[:50] = 0.0
    df = frame(spark, x, z, w).withColumn("w", F.when(F.col("w") > 0, F.col("w")))
    half = frame(spark, x, z, w).filter("w > 0")
    plain = regressor("KRR").with_params(gamma=0.3)
    full = plain.fit(df, ["r"], "z", "w")
    assert full.scaling.centre["r"] == pytest.approx(x[:, 0].mean())
    lasso = regressor("LASSO")
    a = lasso.fit(df, ["r"], "z", "w")
    b = lasso.fit(half, ["r"], "z", "w")
    assert np.abs(predicted(a, df) - predicted(b, df)).max() < 1e-3


def test_cross_validation(spark):
    x, z, w = table()
    v = cross_validate(regressor("LASSO"), frame(spark, x, z, w), selection.with_setting(SETTING, weight="w", cv=4))
    assert 0 < v.sigma.mean < 0.05 and v.eta.mean < 0.05 and v.score.error >= 0 and v.preprocessing == "drop"
    assert v.total.mean == pytest.approx(v.sigma.mean + v.eta.mean)


def test_best_imputation(spark):
    x, z, _ = table()
    df = frame(spark, x, z).withColumn("u", F.when(F.col("k") % 10 > 0, F.col("u")).otherwise(-99.0))
    v = cross_validate(regressor("LASSO"), df, selection.with_setting(SETTING, preprocessing=BEST))
    assert v.preprocessing in ("drop", "mean", "mode", "median")


def test_importance_and_elimination(spark):
    x, z, _ = table()
    df = frame(spark, x, z)
    ranked = selection.permutation_importance(regressor("LASSO"), df, SETTING)
    assert ranked[0]["Feature"] == "r" and {f["Feature"] for f in ranked} == {"r", "u", "Gini index"}
    left, gone = selection.eliminate_features(regressor("LASSO"), df, SETTING)
    assert "r" in left.columns and not {"r", "u"} & set(gone)


def test_morphology_gain(spark):
    x, z, _ = table(120)
    rows = selection.morphology_gain(
        regressor("LASSO"), frame(spark, x, z), SETTING, bands=("r", "u"), features=("Gini index",))
    assert sorted(r["bands"] for r in rows) == ["r", "u"] and rows[0]["score"] <= rows[1]["score"]


def test_training_workflow(spark):
    x, z, _ = table()
    df = frame(spark, x, z)
    cfg = SurveyConfig.open_range(["R", "U"])
    weighted = training.weighted(df, df, ["k"], cfg)
    assert "weight" in weighted.columns and weighted.count() == df.count()
    variants = training.feature_sets(weighted, ["r", "u"])
    assert len(variants) == 3 and "r-u" in variants[1].columns
    result = training.train(
        variants, selection.with_setting(SETTING, weight="weight"), "BEST", max_variants=1,
        overrides={n: SMALL[n] for n in training.COMPARED})
    assert result.variant == 0 and [s["score"] for s in result.scores] == sorted(s["score"] for s in result.scores)
    assert result.regressor.name == result.scores[0]["method"]
    assert result.prediction.scores().rows > 30


def test_feature_sets(spark):
    x, z, _ = table(5)
    df = frame(spark, x, z)
    assert training.feature_sets(df, ["r", "u"], engineer=False) == [df]
    assert [t.columns for t in training.feature_sets(df, ["r", "u"], ["u", "r"])] == [["k", "r", "u-r", "Gini index", "z"]]
    assert feature_columns(df, "z", ["k"]) == ["r", "u", "Gini index"]


def test_folded_feature_sets_share_their_folds(spark):
    x, z, _ = table(120)
    variants = training.folded_feature_sets(frame(spark, x, z), SETTING, ["r", "u"])
    assert len(variants) == 3 and all("fold" in v.columns for v in variants)
    best, results = selection.select_features(regressor("LASSO"), variants, SETTING)
    assert results[best].score.mean == min(v.score.mean for v in results)


def test_search_candidates():
    grid = search.candidates("RF", search.GRID, 0)
    assert len(search.grid_points(search.forest_grid())) == 720
    assert len(grid) == len(search.distinct(grid)) == 3 * 4 * 5 * 3 * 3 + 5 * 3 * 3
    assert 30 < len(search.candidates("RF", search.RANDOM, 50)) <= 50
    assert search.candidates("RF", search.RANDOM, 5) == search.candidates("RF", search.RANDOM, 5)
    for name in search.DRAWS:
        assert len(search.candidates(name, search.GUIDED, 7)) == 7
    assert {p["degree"] for p in search.candidates("KRR", search.GUIDED, 50)} == {1, 3, 5, 7, 9}
    with pytest.raises(ValueError):
        search.candidates("LASSO", search.GUIDED, 1)
    for name in ("RF", "KRR"):
        with pytest.raises(ValueError):
            search.candidates(name, "other", 1)
    with pytest.raises(ValueError):
        search.candidates("SVR", search.GRID, 1)


def test_importance_writes_one_table(spark, monkeypatch):
    from skylattice.learn import selection as module
    from contextlib import contextmanager
    x, z, _ = table(80)
    written, real = [], module.staging

    @contextmanager
    def counting(s):
        with real(s) as stage:
            # tables of errors, which hold no features, are not counted
            yield lambda df: stage(df) if "dz" in df.columns else written.append(1) or stage(df)

    monkeypatch.setattr(module, "staging", counting)
    module.permutation_importance(regressor("LASSO"), frame(spark, x, z), SETTING)
    module.eliminate_features(regressor("LASSO"), frame(spark, x, z), SETTING)
    assert len(written) == 2


def test_staged_tables_are_removed(spark):
    import os
    from skylattice.session import shared_folder, staging
    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    with staging(spark) as stage:
        assert stage(spark.range(3)).count() == 3
    assert set(os.listdir(shared_folder(spark).removeprefix("file://"))) == before


def test_scores_that_steer(spark):
    x, z, _ = table(120)
    plain = cross_validate(regressor("LASSO"), frame(spark, x, z), SETTING)
    total = cross_validate(regressor("LASSO"), frame(spark, x, z), selection.with_setting(SETTING, score="total"))
    own = cross_validate(regressor("LASSO"), frame(spark, x, z), selection.with_setting(SETTING, metric=lambda t: float(t.count())))
    assert plain.chosen == plain.score and total.chosen == total.total and own.chosen.mean * SETTING.cv == 120


def test_forests_share_their_trees(spark):
    """Scores from shared trees equal those of forests fitted one by one."""
    x, z, w = table(240)
    setting = selection.with_setting(SETTING, weight="w")
    part = fold_parts(with_folds(frame(spark, x, z, w), setting), setting)[0]
    points = [{"numTrees": n, "maxDepth": d, "minRowsToSplit": s, "bootstrap": False, "featureSubsetStrategy": r, "minInstancesPerNode": 2}
              for n in (1, 3) for d in (2, 30) for s in (2, 40) for r in ("all", "sqrt")] + [{"numTrees": 40, "bootstrap": True}]
    models = [regressor("RF").with_params(**p) for p in points]
    got = score_candidates(models, part, setting)
    own = _scored([_fit(m, part, setting).table for m in models], setting)[0]
    for a, b in zip(got[:-1], own):
        assert (a[0].sigma, a[0].eta, a[0].bias, a[0].rows) == pytest.approx((b.sigma, b.eta, b.bias, b.rows))
    # a bootstrap is drawn by the number of a row, which differs from table to table
    assert got[-1][0].sigma == pytest.approx(own[-1].sigma, rel=0.3)


def test_forests_of_large_tables_are_fitted_one_by_one(spark, monkeypatch):
    from skylattice.learn import trees
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100)
    x, z, _ = table(240)
    part = fold_parts(with_folds(frame(spark, x, z), SETTING), SETTING)[0]
    found = score_candidates([regressor("RF").with_params(numTrees=2, maxDepth=3, bootstrap=False)], part, SETTING)
    assert 0 < found[0][1] < 0.2


def test_race_keeps_the_best(spark):
    x, z, _ = table(200)
    points = [{"alpha": a} for a in (1e6, 1e5, 0.1, 1e4)]
    setting = selection.with_setting(SETTING, cv=3)
    whole, raced = (search.race(points, "KRR", frame(spark, x, z), setting, r) for r in (None, 2))
    assert [t.folds for t in whole] == [3] * 4 and [t.folds for t in raced] == [1, 1, 3, 2]
    assert raced[2].score == pytest.approx(whole[2].score) == min(t.score for t in whole)


def test_search_takes_the_lowest_score(spark):
    x, z, _ = table(200)
    found = search.optimise("KRR", frame(spark, x, z), SETTING, points=[{"alpha": 1e6}, {"alpha": 0.1}])
    assert found.best.params["alpha"] == 0.1 and found.trials[0].score > found.trials[1].score
    assert found.prediction.scores().sigma < 0.05
