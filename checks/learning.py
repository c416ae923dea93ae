"""Regressors, validation, selection and search.

Cases that SQL can repeat are in ``closed_forms``. The forest searches, the one of kernel ridge and the choice among all
orders of five bands are whole, the searches as races over folds, and so are the rounds of GBR and LGB. XGB runs 20 rounds,
guided boosting is 2 given points of 4 rounds, and guided forests leave out the absolute criterion; README gives the
figures of these cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import view
from skylattice.config import SurveyConfig
from skylattice.learn import search, selection
from skylattice.learn.evaluate import Setting, cross_validate, fit_predict, holdout_parts
from skylattice.learn.regressors import regressor
from skylattice.plans import training

SETTING = Setting(key=("obj_id",), target="z_spec", preprocessing="mean")
SMALL = {
    "RF": {}, "GBR": {}, "XGB": {"maxIter": 20}, "LGB": {},
    "LASSO": {}, "ENET": {}, "KRR": {}, "SVR": {},
}


def train(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "train")


def small(name: str):
    return regressor(name).with_params(**SMALL[name])


def predictions(name: str, weighted: bool = False):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t, setting = train(spark, sf), SETTING
        if weighted:
            t = training.weighted(t, view(spark, sf, "population"), ["obj_id"], SurveyConfig.open_range(["R"]), "r")
            setting = selection.with_setting(SETTING, weight="weight")
        a, b = holdout_parts(t, setting)
        return fit_predict(small(name), a, b, setting).table
    return query


def validation(name: str, preprocessing="mean"):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = cross_validate(small(name), train(spark, sf), selection.with_setting(SETTING, preprocessing=preprocessing))
        rows = [{"measure": n, "mean": getattr(v, n).mean, "error": getattr(v, n).error, "preprocessing": str(v.preprocessing)}
                for n in ("sigma", "eta", "score", "total")]
        return selection.report_table(spark, rows, "measure string, mean double, error double, preprocessing string")
    return query


def importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.permutation_importance(small("LASSO"), train(spark, sf), SETTING)
    return selection.report_table(spark, rows, "Feature string, score double, Weight string")


def elimination(spark: SparkSession, sf: str) -> DataFrame:
    left, _ = selection.eliminate_features(small("LASSO"), train(spark, sf), SETTING)
    return left


def gain(spark: SparkSession, sf: str) -> DataFrame:
    t = train(spark, sf).withColumnRenamed("gini", "Gini index")
    # band z is too sparse and leaves every run
    rows = selection.morphology_gain(small("LASSO"), t, SETTING, bands=("r", "i", "g", "u"), features=("Gini index",))
    return selection.report_table(
        spark, rows, "bands string, `score diff.` string, `score w. morph` string, `score w.o. morph` string, score double")


def choose_features(spark: SparkSession, sf: str) -> DataFrame:
    table = train(spark, sf).select("obj_id", "r", "u", "i", "g", "z", "z_spec")
    variants = training.folded_feature_sets(table, SETTING, ("r", "u", "i", "g", "z"))
    best, results = selection.select_features(small("LASSO"), variants, SETTING)
    rows = [{"variant": i, "score": v.score.mean, "best": i == best} for i, v in enumerate(results)]
    return selection.report_table(spark, rows, "variant int, score double, best boolean")


def choose_regressor(spark: SparkSession, sf: str) -> DataFrame:
    result = training.train([train(spark, sf)], SETTING, "BEST", overrides=SMALL)
    return selection.report_table(
        spark, result.scores, "method string, variant int, preprocessing string, score double, score_error double,"
                              " sigma double, sigma_error double, eta double, eta_error double")


def searched(name: str, method: str, points=None, evals: int = 2, racing: int | None = None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = search.optimise(name, train(spark, sf), SETTING, method, evals, points, racing)
        return found.prediction.table
    return query


def ranked_features(spark: SparkSession, sf: str) -> DataFrame:
    """Order of the features by importance, as a column of its own."""
    rows = selection.permutation_importance(small("LASSO"), train(spark, sf), SETTING)
    return selection.report_table(spark, [{"rank": k, "Feature": r["Feature"]} for k, r in enumerate(rows)], "rank int, Feature string")


_DRAWN_FORESTS = [{**p, "criterion": "squared"} for p in search.candidates("RF", search.GUIDED, 200)]

QUERIES = {
    **{f"predict_{n.lower()}": predictions(n) for n in SMALL},
    "predict_weighted": predictions("LASSO", weighted=True),
    "validate_lasso": validation("LASSO"),
    "validate_forest": validation("RF"),
    "validate_best_imputation": validation("LASSO", "BEST"),
    "permutation_importance": importance,
    "eliminate_features": elimination,
    "morphology_gain": gain,
    "select_features": choose_features,
    "select_regressor": choose_regressor,
    "ranked_features": ranked_features,
    "grid_search_forest": searched("RF", search.GRID, racing=4),
    "random_search_forest": searched("RF", search.RANDOM, evals=200, racing=4),
    "guided_search_forest": searched("RF", search.GUIDED, _DRAWN_FORESTS, racing=4),
    "guided_search_krr": searched("KRR", search.GUIDED, evals=200, racing=10),
    "guided_search_svr": searched("SVR", search.GUIDED, evals=200, racing=2),
    "guided_search_boosting": searched("XGB", search.GUIDED, [{"maxIter": 4, "maxDepth": 3, "stepSize": s} for s in (0.05, 0.1)]),
}
ORACLES: dict[str, str] = {}
