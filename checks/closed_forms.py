"""Learning on cases whose answer SQL can repeat: one or two features, one split, folds and gaps as they are.

The queries run the same code as those with full presets. A case is a relation ``rel (k, is_train, key, y, x..)``
with one fit per ``k``; each model is SQL from ``rel`` to ``pred (k, obj_id, y, p)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import ctes, view
from checks.tables import LIMIT, mixed_sql, rounded
from skylattice.learn import search, selection
from skylattice.learn.evaluate import BEST, Setting, cross_validate, fit_predict, holdout_parts
from skylattice.learn.regressors import regressor
from skylattice.operators.folds import MODULUS
from skylattice.plans import training

SETTING = Setting(key=("obj_id",), target="z_spec", preprocessing="mean")
LASSO = regressor("LASSO").with_params(tol=1e-14, maxIter=2000)
OLS = LASSO.with_params(alpha=0.0)
TREE = {"maxDepth": 1, "maxBins": 2048, "featureSubsetStrategy": "all"}
STUMP = regressor("RF").with_params(numTrees=1, bootstrap=False, **TREE)
KERNEL = regressor("KRR").with_params(degree=1)


def table(spark: SparkSession, sf: str, *features: str) -> DataFrame:
    return view(spark, sf, "train").select("obj_id", *features, "z_spec")


# --- queries -------------------------------------------------------------------------------

def predicted(model, feature: str, weighted: bool = False):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t, setting = table(spark, sf, feature), SETTING
        if weighted:
            t = t.withColumn("w", F.lit(0.5) + (F.col("obj_id") % 7) / 4)
            setting = selection.with_setting(SETTING, weight="w")
        return rounded(fit_predict(model, *holdout_parts(t, setting), setting).table, "y_test", "y_pred", digits=6)
    return query


def least_split(spark: SparkSession, sf: str) -> DataFrame:
    """Of the two sides of the first split one at most has the rows to be split again."""
    part, test = holdout_parts(table(spark, sf, "r").withColumn("w", F.lit(0.5) + (F.col("obj_id") % 7) / 4), SETTING)
    model = STUMP.with_params(maxDepth=2, minRowsToSplit=SPLIT * part.count() // 100)
    return rounded(fit_predict(model, part, test, selection.with_setting(SETTING, weight="w")).table, "y_test", "y_pred", digits=6)


def validated(spark, v) -> DataFrame:
    rows = [{"measure": n, "mean": round(getattr(v, n).mean, 8), "error": round(getattr(v, n).error, 8)} for n in ("sigma", "eta", "score", "total")]
    return selection.report_table(spark, rows, "measure string, mean double, error double")


def validate(model, feature: str, preprocessing):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return validated(spark, cross_validate(model, table(spark, sf, feature), selection.with_setting(SETTING, preprocessing=preprocessing)))
    return query


def validate_part(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out with a validation part: what is left to train on decides the fit."""
    setting = selection.with_setting(SETTING, validation=True)
    return rounded(fit_predict(LASSO, *holdout_parts(table(spark, sf, "g"), setting), setting).table, "y_test", "y_pred", digits=6)


def chosen(**changes):
    """Choice among feature sets by another score, or by a metric of the caller's."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        setting = selection.with_setting(SETTING, **changes)
        variants = [table(spark, sf, f) for f in ("g", "gini", "r")]
        _, found = selection.select_features(LASSO, variants, setting)
        rows = [{"feature": f, "score": round(v.chosen.mean, 8)} for f, v in zip(("g", "gini", "r"), found)]
        return selection.report_table(spark, rows, "feature string, score double")
    return query


def worst_error(predictions: DataFrame) -> float:
    return predictions.agg(F.max(F.abs(F.col("y_test") - F.col("y_pred")))).first()[0]


def importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.permutation_importance(OLS, table(spark, sf, "g", "r"), SETTING)
    return rounded(selection.report_table(spark, rows, "Feature string, score double"), "score", digits=7)


def elimination(spark: SparkSession, sf: str) -> DataFrame:
    left, gone = selection.eliminate_features(OLS, table(spark, sf, "g", "r"), SETTING)
    return left.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(",".join(c for c in left.columns if c not in ("obj_id", "z_spec"))).alias("features_left"))


def gain(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "r", "g", "gini").withColumnRenamed("gini", "Gini index")
    rows = selection.morphology_gain(OLS, t, SETTING, bands=("r", "g"), features=("Gini index",))
    return rounded(selection.report_table(spark, rows, "bands string, score double"), "score", digits=7)


def methods(spark: SparkSession, sf: str) -> DataFrame:
    """The better of two regressors on one feature."""
    best, _, rows = selection.select_regressor([LASSO, KERNEL], [table(spark, sf, "g")], SETTING)
    rows = [{"method": r["method"], "score": round(r["score"], 8), "sigma": round(r["sigma"], 8), "best": r["method"] == best.name} for r in rows]
    return selection.report_table(spark, rows, "method string, score double, sigma double, best boolean")


ALPHAS = (0.0005, 0.05, 0.5)
KERNEL_POINTS = [{"degree": 1, "alpha": a, "gamma": 1.0, "coef0": 2.5} for a in (0.6, 3000.0, 30000.0)]
LEAVES = (1, 4000)
#: Percent of the rows that a node must have to be split again in ``closed_forest_least_split``: more than one side can have.
SPLIT = 55


def searched(name: str, points: list[dict]):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = search.optimise(name, table(spark, sf, "g"), SETTING, points=points)
        score = min(t.score for t in found.trials)
        return rounded(found.prediction.table, "y_test", "y_pred", digits=6).withColumn("best_score", F.lit(round(score, 7)))
    return query


# --- SQL -----------------------------------------------------------------------------------

GROUP = f"CAST(floor({mixed_sql('obj_id', 1)}*CAST(ceil((SELECT count(*) FROM train)/1e5) AS BIGINT)/{MODULUS}e0) AS INTEGER)"
PARTS = (f"held AS (SELECT *, CASE WHEN {mixed_sql('obj_id', 0)}<{LIMIT} THEN 'test' ELSE 'train' END AS part FROM train)")


def _folded(source: str = "train", name: str = "folded") -> str:
    return (f"{name} AS (SELECT *, CAST(least(3, (row_number() OVER (ORDER BY {mixed_sql('obj_id', 0)})-1)"
            f" // ((SELECT count(*) FROM {source})//4)) AS INTEGER) AS fold FROM {source})")


def _clean(c: str) -> str:
    return f"CASE WHEN {c} NOT IN (-1e0,-1e1,-99e0) THEN {c} END"


def _held_rel(x: str) -> str:
    return f"{PARTS}, rel AS (SELECT 0 AS k, part='train' AS is_train, obj_id, z_spec AS y, {x} AS x, 1e0 AS w FROM held)"


def _fold_rel(*features: str) -> str:
    """One fit for each fold; ``features`` become x, or x1 and x2."""
    names = ("x",) if len(features) == 1 else ("x1", "x2")
    cols = ", ".join(f"{f} AS {n}" for f, n in zip(features, names))
    return f"{_folded()}, rel AS (SELECT f AS k, fold<>f AS is_train, obj_id, z_spec AS y, 1e0 AS w, {cols} FROM folded, range(4) t(f))"


def _linear(alpha: str = "5e-4", l1: float = 1.0, rel: str = "rel", out: str = "pred") -> str:
    """Soft threshold on the robustly scaled feature."""
    return (
        f"{out}_st AS (SELECT k, avg(y) AS my, avg(x) AS mx, var_pop(x) AS v, covar_pop(x,y) AS c,"
        f" quantile_cont(x,7.5e-1)-quantile_cont(x,2.5e-1) AS s FROM {rel} WHERE is_train GROUP BY k),"
        f" {out}_b AS (SELECT *, sign(c)*greatest(abs(c/s)-({alpha})*{l1!r}e0,0e0)/(v/s/s+({alpha})*{1 - l1!r}e0)/s AS b FROM {out}_st),"
        f" {out} AS (SELECT k, obj_id, y, my+b*(x-mx) AS p FROM {rel} JOIN {out}_b USING (k) WHERE NOT is_train)"
    )


def _plane(rel: str = "rel", out: str = "pred") -> str:
    """Least squares on two features."""
    return (
        f"{out}_st AS (SELECT k, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1,x2) AS v12,"
        f" covar_pop(x1,y) AS c1, covar_pop(x2,y) AS c2 FROM {rel} WHERE is_train GROUP BY k),"
        f" {out} AS (SELECT k, obj_id, y, my+((c1*v2-c2*v12)*(x1-m1)+(c2*v1-c1*v12)*(x2-m2))/(v1*v2-v12*v12) AS p"
        f" FROM {rel} JOIN {out}_st USING (k) WHERE NOT is_train)"
    )


def _kernel(alpha: str = "6e-1", rel: str = "rel", out: str = "pred") -> str:
    """Ridge in the two terms of a kernel of degree one."""
    return (
        f"{out}_m AS (SELECT k, avg(x) AS mx, stddev_pop(x) AS s FROM {rel} WHERE is_train GROUP BY k),"
        f" {out}_st AS (SELECT k, min(mx) AS mx, min(s) AS s, count(*) AS n, sum(y) AS sy, sum((x-mx)/s*y) AS sxy"
        f" FROM {rel} JOIN {out}_m USING (k) WHERE is_train GROUP BY k),"
        f" {out} AS (SELECT k, obj_id, y, 2.5e0*sy/(n*2.5e0+({alpha}))+(x-mx)/s*sxy/(n+({alpha})) AS p"
        f" FROM {rel} JOIN {out}_st USING (k) WHERE NOT is_train)"
    )


def _stump(y: str = "y", rel: str = "rel", out: str = "pred", least: str = "1", ridge: str = "0e0", split: str = "2") -> str:
    """Best single split by second-order gain, the answers on both sides and the gain, for all rows of ``rel``."""
    return (
        f"{out}_v AS (SELECT k, x, sum(w) AS n, sum(w*{y}) AS s, count(*) AS rows FROM {rel} WHERE is_train GROUP BY k, x),"
        f" {out}_c AS (SELECT k, x, lead(x) OVER o AS nx, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(rows) OVER o AS rl,"
        f" sum(n) OVER a AS nt, sum(s) OVER a AS st, sum(rows) OVER a AS rt FROM {out}_v WINDOW o AS (PARTITION BY k ORDER BY x), a AS (PARTITION BY k)),"
        f" {out}_g AS (SELECT *, sl*sl/(nl+{ridge})+(st-sl)*(st-sl)/(nt-nl+{ridge}) AS top FROM {out}_c"
        f" WHERE nx IS NOT NULL AND rl>=({least}) AND rt-rl>=({least}) AND rt>=({split})),"
        f" {out}_t AS (SELECT k, arg_max(struct_pack(cut := (x+nx)/2e0, l := sl/(nl+{ridge}), r := (st-sl)/(nt-nl+{ridge}), gain := top-st*st/(nt+{ridge})), top) AS t"
        f" FROM {out}_g GROUP BY k),"
        f" {out}_m AS (SELECT k, sum(s)/(sum(n)+{ridge}) AS m FROM {out}_v GROUP BY k),"
        f" {out}_all AS (SELECT {rel}.*, CASE WHEN t.t IS NULL THEN m.m WHEN x<=t.t.cut THEN t.t.l ELSE t.t.r END AS p, m.m AS unsplit,"
        f" CASE WHEN t.t IS NULL THEN 0 WHEN x<=t.t.cut THEN 1 ELSE 2 END AS side, coalesce(t.t.gain, 0e0) AS gain"
        f" FROM {rel} JOIN {out}_m m USING (k) LEFT JOIN {out}_t t USING (k)),"
        f" {out} AS (SELECT k, obj_id, y, p FROM {out}_all WHERE NOT is_train)"
    )


def _two_levels(rel: str = "rel", out: str = "pred", **limits) -> str:
    """The best split and the best splits of both sides."""
    return (f"{_stump(rel=rel, out='upper', **limits)}, lower_rel AS (SELECT k*3+side AS k, is_train, obj_id, y, x, w FROM upper_all),"
            f" {_stump(rel='lower_rel', out=out, **limits)}")


def _scores(pred: str = "pred", out: str = "sc") -> str:
    return (
        f"{out}_d AS (SELECT k, (y-p)/(1e0+y) AS dz FROM {pred}), {out}_m AS (SELECT k, median(dz) AS m, avg(dz) AS b FROM {out}_d GROUP BY k),"
        f" {out}_s AS (SELECT d.k, 1.4826e0*median(abs(dz-m)) AS sigma, avg(CASE WHEN abs(dz)>1.5e-1 THEN 1e0 ELSE 0e0 END) AS eta, min(b) AS b"
        f" FROM {out}_d d JOIN {out}_m m ON m.k=d.k GROUP BY d.k),"
        f" {out} AS (SELECT k, sigma, eta, sqrt(b*b+sigma*sigma) AS score, sigma+eta AS total FROM {out}_s)"
    )


def _summary(source: str = "sc") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS measure, round(avg({m}),8) AS mean, round(stddev_pop({m})/sqrt(count(*)),8) AS error FROM {source}"
        for m in ("sigma", "eta", "score", "total"))


_PREDICTED = " SELECT obj_id, round(y,6) AS y_test, round(p,6) AS y_pred FROM pred"
_TRAIN = f"WITH {ctes('train')}, "


def _boosted(rounds: int, rate: str = "5e-2", base: str = "avg(y)", **limits) -> str:
    """Stumps on what the answers so far leave, each taken at a rate."""
    steps = [f"b0 AS (SELECT *, (SELECT {base} FROM rel WHERE is_train) AS f0 FROM rel)"]
    for r in range(rounds):
        steps.append(f"z{r} AS (SELECT k, is_train, obj_id, y, x, w, f{r}, y-f{r} AS z FROM b{r}), {_stump(y='z', rel=f'z{r}', out=f's{r}', **limits)},"
                     f" b{r + 1} AS (SELECT k, is_train, obj_id, y, x, w, f{r}+{rate}*p AS f{r + 1} FROM s{r}_all)")
    return f"{_TRAIN}{_held_rel('g')}, {', '.join(steps)} SELECT obj_id, round(y,6) AS y_test, round(f{rounds},6) AS y_pred FROM b{rounds} WHERE NOT is_train"


def _three_leaves(rate: str = "5e-2", least: str = "11") -> str:
    """One round by best leaf: of the two sides the one that gains more is split again."""
    return (f"{_TRAIN}{_held_rel('g')}, b0 AS (SELECT *, (SELECT avg(y) FROM rel WHERE is_train) AS f0 FROM rel), z0 AS (SELECT *, y-f0 AS z FROM b0),"
            f" {_stump(y='z', rel='z0', out='upper', least=least)},"
            f" sides AS (SELECT k*3+side AS k, is_train, obj_id, y, x, w, f0, z FROM upper_all), {_stump(y='z', rel='sides', out='lower', least=least)}"
            f" SELECT obj_id, round(y,6) AS y_test, round(f0+{rate}*CASE WHEN k=(SELECT arg_max(k, gain) FROM lower_all) THEN p ELSE unsplit END,6) AS y_pred"
            " FROM lower_all WHERE NOT is_train")


def _gaps(fill: str | None, number: int) -> str:
    """Relation of four folds of ``u`` with gaps dropped or filled from the train part."""
    rel = f"SELECT {number}*4+f AS k, fold<>f AS is_train, obj_id, z_spec AS y, {_clean('u')} AS u, 1e0 AS w FROM folded, range(4) t(f)"
    if fill is None:
        return f"g{number} AS (SELECT k, is_train, obj_id, y, u AS x, w FROM ({rel}) WHERE u IS NOT NULL)"
    return (f"g{number}r AS ({rel}), g{number}f AS (SELECT k, {fill} AS fill FROM g{number}r WHERE is_train AND u IS NOT NULL GROUP BY k),"
            f" g{number} AS (SELECT k, is_train, obj_id, y, coalesce(u, fill) AS x, w FROM g{number}r JOIN g{number}f USING (k))")


FILLS = (None, "avg(u)", "mode(u)", "median(u)")


def _mode() -> str:
    rel = f"SELECT 8+f AS k, fold<>f AS is_train, obj_id, z_spec AS y, {_clean('u')} AS u, 1e0 AS w FROM folded, range(4) t(f)"
    return (f"g2r AS ({rel}), g2c AS (SELECT k, u, count(*) AS n FROM g2r WHERE is_train AND u IS NOT NULL GROUP BY k, u),"
            " g2f AS (SELECT k, arg_min(u, struct_pack(n := -n, u := u)) AS fill FROM g2c GROUP BY k),"
            " g2 AS (SELECT k, is_train, obj_id, y, coalesce(u, fill) AS x, w FROM g2r JOIN g2f USING (k))")


def _best_sql() -> str:
    gaps = ", ".join(_mode() if f == "mode(u)" else _gaps(f, i) for i, f in enumerate(FILLS))
    union = " UNION ALL ".join(f"SELECT k, is_train, obj_id, y, x, w FROM g{i}" for i in range(4))
    return (f"{_TRAIN}{_folded()}, {gaps}, rel AS ({union}), {_linear()}, {_scores()},"
            f" best AS (SELECT arg_min(struct_pack(sigma := sigma, eta := eta, score := score, total := total), struct_pack(s := score, k := k)) AS v FROM sc GROUP BY k%4),"
            f" flat AS (SELECT v.sigma AS sigma, v.eta AS eta, v.score AS score, v.total AS total FROM best) {_summary('flat')}")


def _moved(c: str) -> str:
    over = f"OVER (PARTITION BY {GROUP} ORDER BY {mixed_sql('obj_id', 7920)}, obj_id)"
    return f"coalesce(lead({c}) {over}, first_value({c}) {over})"


def _variants(pairs: dict[str, tuple[str, ...]]) -> str:
    """Mean score of least squares on each set of features, as ``means (name, score)``."""
    parts = []
    for i, f in enumerate(pairs.values()):
        cols = ", ".join(f"{c} AS {n}" for c, n in zip(f, ("x1", "x2") if len(f) == 2 else ("x",)))
        parts.append(f"r{i} AS (SELECT f AS k, fold<>f AS is_train, obj_id, z_spec AS y, {cols} FROM folded, range(4) t(f)),"
                     f" {_plane(f'r{i}', f'p{i}') if len(f) == 2 else _linear('0e0', 1.0, f'r{i}', f'p{i}')}, {_scores(f'p{i}', f's{i}')}")
    means = " UNION ALL ".join(f"SELECT '{n}' AS name, avg(score) AS score FROM s{i}" for i, n in enumerate(pairs))
    return f"{', '.join(parts)}, means AS ({means})"


def _importance_cte() -> str:
    return (f"{_TRAIN}shifted AS (SELECT *, {_moved('g')} AS g_, {_moved('r')} AS r_ FROM train), {_folded('shifted')}, "
            + _variants({"base": ("g", "r"), "g": ("g_", "r"), "r": ("g", "r_"), "only_g": ("g",), "only_r": ("r",)}))


_MEAN = "(SELECT score FROM means WHERE name='{}')"
_SEARCH_FOLDS = f"tr AS (SELECT * FROM held WHERE part='train'), {_folded('tr')}"


def _search_sql(points: list[str], model) -> str:
    """Scores of all points over folds of the train part, then the best point on the hold-out part."""
    values = ", ".join(f"({i}, {p})" for i, p in enumerate(points))
    return (
        f"{_TRAIN}{PARTS}, {_SEARCH_FOLDS}, pts(q, a) AS (VALUES {values}),"
        f" cv AS (SELECT q*4+f AS k, fold<>f AS is_train, obj_id, z_spec AS y, g AS x, 1e0 AS w, a FROM folded, range(4) t(f), pts),"
        f" {model('(SELECT any_value(a) FROM pts WHERE q=k//4)', 'cv', 'cp')}, {_scores('cp')},"
        f" tried AS (SELECT k//4 AS q, avg(score) AS score FROM sc GROUP BY 1), best AS (SELECT arg_min(q, struct_pack(s := score, q := q)) AS q, min(score) AS score FROM tried),"
        f" rel AS (SELECT 0 AS k, part='train' AS is_train, obj_id, z_spec AS y, g AS x, 1e0 AS w FROM held),"
        f" {model('(SELECT any_value(a) FROM pts JOIN best USING (q))', 'rel', 'pred')}"
        " SELECT obj_id, round(y,6) AS y_test, round(p,6) AS y_pred, round((SELECT score FROM best),7) AS best_score FROM pred")


def _choice_sql(measure: str) -> str:
    parts = ", ".join(
        f"r{f} AS (SELECT f AS k, fold<>f AS is_train, obj_id, z_spec AS y, {f} AS x FROM folded, range(4) t(f)), {_linear(rel=f'r{f}', out=f'p{f}')}, {_scores(f'p{f}', f's{f}')}"
        for f in ("g", "gini", "r"))
    value = "avg({})" if measure != "worst" else None
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round({value.format(measure)},8) AS score FROM s{f}" if value else
        f"SELECT '{f}' AS feature, round(avg(m),8) AS score FROM (SELECT k, max(abs(y-p)) AS m FROM p{f} GROUP BY k)" for f in ("g", "gini", "r"))
    return f"{_TRAIN}{_folded()}, {parts} {rows}"


QUERIES = {
    "closed_lasso": predicted(LASSO, "g"),
    "closed_enet": predicted(regressor("ENET").with_params(tol=1e-14, maxIter=2000), "g"),
    "closed_krr": predicted(KERNEL, "g"),
    "closed_forest": predicted(STUMP, "g"),
    "closed_forest_weighted": predicted(STUMP, "g", weighted=True),
    "closed_forest_two_levels": predicted(STUMP.with_params(maxDepth=2), "g"),
    "closed_forest_least_split": least_split,
    "closed_gbr_one_round": predicted(regressor("GBR").with_params(maxIter=1, **TREE), "g"),
    "closed_gbr": predicted(regressor("GBR").with_params(maxIter=2, **TREE), "g"),
    "closed_xgb": predicted(regressor("XGB").with_params(maxIter=2, ridge=50.0, **TREE), "g"),
    "closed_lgb": predicted(regressor("LGB").with_params(maxIter=1, leaves=3, subsamplingRate=1.0, maxBins=2048), "g"),
    "closed_validate": validate(LASSO, "g", "mean"),
    "closed_validate_gaps": validate(LASSO, "u", "drop"),
    "closed_validation_part": validate_part,
    "closed_best_imputation": validate(LASSO, "u", BEST),
    "closed_importance": importance,
    "closed_elimination": elimination,
    "closed_morphology_gain": gain,
    "closed_choice_by_total": chosen(score="total"),
    "closed_choice_by_metric": chosen(metric=worst_error),
    "closed_select_regressor": methods,
    "closed_grid_search": searched("RF", [search.forest_params(p) for p in search.grid_points(
        {"numTrees": [1], "maxDepth": [1], "maxBins": [2048], "featureSubsetStrategy": ["all"], "minInstancesPerNode": list(LEAVES), "bootstrap": [False]})]),
    "closed_search_krr": searched("KRR", KERNEL_POINTS),
}

ORACLES = {
    "closed_lasso": f"{_TRAIN}{_held_rel('g')}, {_linear()}{_PREDICTED}",
    "closed_enet": f"{_TRAIN}{_held_rel('g')}, {_linear(l1=0.9)}{_PREDICTED}",
    "closed_krr": f"{_TRAIN}{_held_rel('g')}, {_kernel()}{_PREDICTED}",
    "closed_forest": f"{_TRAIN}{_held_rel('g')}, {_stump()}{_PREDICTED}",
    "closed_forest_weighted": f"{_TRAIN}{PARTS}, rel AS (SELECT 0 AS k, part='train' AS is_train, obj_id, z_spec AS y, g AS x,"
                              f" 5e-1+(obj_id%7)/4e0 AS w FROM held), {_stump()}{_PREDICTED}",
    "closed_forest_two_levels": f"{_TRAIN}{_held_rel('g')}, {_two_levels()}{_PREDICTED}",
    "closed_forest_least_split": f"{_TRAIN}{PARTS}, rel AS (SELECT 0 AS k, part='train' AS is_train, obj_id, z_spec AS y, r AS x,"
                                 f" 5e-1+(obj_id%7)/4e0 AS w FROM held), {_two_levels(split=f'(SELECT {SPLIT}*count(*)//100 FROM rel WHERE is_train)')}{_PREDICTED}",
    "closed_gbr_one_round": _boosted(1),
    "closed_gbr": _boosted(2),
    "closed_xgb": _boosted(2, rate="3e-1", base="min(5e-1)", ridge="5e1"),
    "closed_lgb": _three_leaves(),
    "closed_validate": f"{_TRAIN}{_fold_rel('g')}, {_linear()}, {_scores()} {_summary()}",
    "closed_validate_gaps": f"{_TRAIN}{_folded()}, {_gaps(None, 0)}, {_linear(rel='g0')}, {_scores()} {_summary()}",
    "closed_validation_part": f"{_TRAIN}held AS (SELECT *, CASE WHEN {mixed_sql('obj_id', 0)}<{LIMIT} THEN 'test' WHEN {mixed_sql('obj_id', 1)}<{LIMIT}"
                              " THEN 'validation' ELSE 'train' END AS part FROM train), rel AS (SELECT 0 AS k, part='train' AS is_train, obj_id, z_spec AS y, g AS x"
                              f" FROM held WHERE part<>'validation'), {_linear()}{_PREDICTED}",
    "closed_best_imputation": _best_sql(),
    "closed_importance": _importance_cte() + " SELECT name AS \"Feature\", round(" + _MEAN.format("base")
                         + "-score,7) AS score FROM means WHERE name IN ('g','r')",
    "closed_elimination": _importance_cte() + ", w AS (SELECT arg_min(name, struct_pack(s := score)) AS weakest FROM means WHERE name IN ('g','r')),"
                          " a AS (SELECT CASE WHEN weakest='g' THEN 'r' ELSE 'g' END AS other FROM w)"
                          " SELECT (SELECT count(*) FROM train) AS n, CASE WHEN (SELECT score FROM means WHERE name='only_'||other)<"
                          + _MEAN.format("base") + " THEN other ELSE 'g,r' END AS features_left FROM a",
    "closed_morphology_gain": f"{_TRAIN}{_folded()}, " + _variants({"ag": ("g", "gini"), "bg": ("g",), "ar": ("r", "gini"), "br": ("r",)})
                              + " SELECT 'g' AS bands, round(" + _MEAN.format("ag") + "-" + _MEAN.format("bg") + ",7) AS score UNION ALL SELECT 'r', round("
                              + _MEAN.format("ar") + "-" + _MEAN.format("br") + ",7)",
    "closed_choice_by_total": _choice_sql("total"),
    "closed_choice_by_metric": _choice_sql("worst"),
    "closed_select_regressor": f"{_TRAIN}{_fold_rel('g')}, {_linear(out='pl')}, {_kernel(out='pk')}, {_scores('pl', 'sl')}, {_scores('pk', 'sk')},"
                               " m AS (SELECT 'LASSO' AS method, avg(score) AS score, avg(sigma) AS sigma FROM sl UNION ALL"
                               " SELECT 'KRR', avg(score), avg(sigma) FROM sk) SELECT method, round(score,8) AS score, round(sigma,8) AS sigma,"
                               " score=(SELECT min(score) FROM m) AS best FROM m",
    "closed_grid_search": _search_sql([str(x) for x in LEAVES], lambda a, rel, out: _stump(rel=rel, out=out, least=a)),
    "closed_search_krr": _search_sql(["6e-1", "3e3", "3e4"], lambda a, rel, out: _kernel(a, rel, out)),
}
