"""Fitting, prediction and cross-validation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.learn import fold_algebra, forest_search, kernel_search, regressors, vector_search
from skylattice.learn.features import feature_columns
from skylattice.learn.regressors import LABEL, PREDICTION, Fitted, Regressor
from skylattice.operators import folds, impute, metrics
from skylattice.operators.metrics import Scores, Summary
from skylattice.operators.project import numeric_columns
from skylattice.session import staging
from skylattice.sources.tables import union_tables

BEST = "BEST"


@dataclass(frozen=True)
class Setting:
    """What a training table means: its key, target, optional weight, and how to treat gaps."""

    key: tuple[str, ...]
    target: str = "Z spec"
    weight: str | None = None
    preprocessing: str | float | None = "drop"
    cv: int = 4
    seed: int = 0
    parallelism: int = 4
    #: Which score chooses: ``score``, ``total``, ``sigma`` or ``eta``.
    score: str = "score"
    #: A metric of one's own, of a table with ``y_test`` and ``y_pred``; lower is better. It replaces ``score``.
    metric: Callable[[DataFrame], float] | None = None
    #: Whether the hold-out split keeps a validation part back too.
    validation: bool = False

    @property
    def bookkeeping(self) -> tuple[str, ...]:
        return self.key + ((self.weight,) if self.weight else ()) + ("fold", "part")


@dataclass(frozen=True)
class Validation:
    """Cross-validated scores: mean and error over the folds; ``chosen`` is the one that steers a choice."""

    sigma: Summary
    eta: Summary
    score: Summary
    total: Summary
    preprocessing: str | float | None
    chosen: Summary


@dataclass(frozen=True)
class Prediction:
    fitted: Fitted
    table: DataFrame
    preprocessing: str | float | None

    def scores(self) -> Scores:
        return metrics.scores(self.table)


def run_all(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Independent fits side by side; Spark shares its executors among them."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def holdout_parts(df: DataFrame, setting: Setting, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the fixed hold-out split."""
    parts = folds.holdout(df, setting.key, share, setting.seed, setting.validation)
    return (parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part"))


def validation_part(df: DataFrame, setting: Setting, share: float = 0.2) -> DataFrame:
    """The rows that neither fit nor test, of a setting with a validation part."""
    if not setting.validation:
        raise ValueError("the setting keeps no validation part")
    return folds.holdout(df, setting.key, share, setting.seed, True).filter("part = 'validation'").drop("part")


@dataclass(frozen=True)
class Part:
    """One fit: preprocessed train and test rows of a fold."""

    fold: int
    method: str | float | None
    train: DataFrame
    test: DataFrame


def fit_predict(regressor: Regressor, train: DataFrame, test: DataFrame, setting: Setting) -> Prediction:
    """Preprocess both parts, fit on the train part, predict the test part.

    The prediction table holds the key, ``y_test`` and ``y_pred``. With ``BEST`` each way of
    treating gaps starts from the same parts, and the one with the lowest score is taken.
    """
    jobs = [lambda m=m: _fit(regressor, _part(0, train, test, setting, m), setting) for m in methods_of(setting)]
    tried = run_all(train.sparkSession, jobs, setting.parallelism)
    if len(tried) == 1:
        return tried[0]
    return tried[_best_of(tried, setting)]


def methods_of(setting: Setting) -> tuple:
    return impute.METHODS if setting.preprocessing == BEST else (setting.preprocessing,)


def _part(fold: int, train: DataFrame, test: DataFrame, setting: Setting, method) -> Part:
    train, test, _ = impute.preprocess(train, test, method, keep=setting.bookkeeping, protect=[setting.target])
    return Part(fold, method, train, test)


def _fit(regressor: Regressor, part: Part, setting: Setting) -> Prediction:
    features = feature_columns(part.train, setting.target, setting.bookkeeping)
    fitted = regressor.fit(part.train, features, setting.target, setting.weight)
    keep = [c for c in (*setting.key, "fold") if c in part.test.columns]
    table = fitted.predict(part.test).select(
        *keep, F.col(f"`{setting.target}`").cast("double").alias(LABEL), F.col(PREDICTION).cast("double")
    )
    return Prediction(fitted, table, part.method)


def _scored(tables: Sequence[DataFrame], setting: Setting) -> tuple[list[Scores], list[float]]:
    """Scores of each prediction table, and the number that steers a choice.

    The tables are computed and written once and scored together.
    """
    parts = [t.select(LABEL, PREDICTION).withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    # Written, so that a lost executor costs a re-read and no fit.
    with staging(tables[0].sparkSession) as stage:
        whole = stage(union_tables(parts))
        found = metrics.scores_by(whole, "_table", list(range(len(tables))))
        scores = [found[i] for i in range(len(tables))]
        if setting.metric is None:
            return scores, [getattr(s, setting.score) for s in scores]
        return scores, [float(setting.metric(whole.filter(F.col("_table") == i).drop("_table"))) for i in range(len(tables))]


def _best_of(tried: Sequence[Prediction], setting: Setting) -> int:
    _, chosen = _scored([p.table for p in tried], setting)
    return min(range(len(tried)), key=lambda i: (chosen[i], i))


def cross_validate(regressor: Regressor, df: DataFrame, setting: Setting) -> Validation:
    """k-fold cross-validation over folds scattered by the key.

    The folded table is written once and every fold reads it. All folds' predictions form one
    table, so the exact medians of all folds come from shared passes.
    """
    with staging(df.sparkSession) as stage:
        return validate_folds(regressor, stage(with_folds(df, setting)), setting)


def with_folds(df: DataFrame, setting: Setting) -> DataFrame:
    return folds.shuffled_folds(df, setting.key, setting.cv, setting.seed, exact=True)


def fold_parts(folded: DataFrame, setting: Setting, stage: Callable[[DataFrame], DataFrame] | None = None) -> list[Part]:
    """Preprocessed parts of every fold and way of treating gaps.

    They do not depend on a regressor: with ``stage`` they are written once, for many fits.
    """
    def one(i: int, method) -> Part:
        part = _part(i, folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i), setting, method)
        return part if stage is None else Part(i, method, stage(part.train), stage(part.test))

    jobs = [lambda i=i, m=m: one(i, m) for i in range(setting.cv) for m in methods_of(setting)]
    return run_all(folded.sparkSession, jobs, setting.parallelism)


def score_candidates(candidates: Sequence[Regressor], part: Part, setting: Setting, at_once: int = 16) -> list[tuple[Scores, float]]:
    """Scores of each regressor on a part, and the number that steers a choice.

    Forests of a table of few rows share their trees, support vectors of one their rows, kernel ridges their sums; others are
    fitted side by side.
    """
    features = feature_columns(part.train, setting.target, setting.bookkeeping)
    if candidates and setting.metric is None and all(c.family is regressors._forest and c.scaling is None for c in candidates):
        found = forest_search.scores([c.params for c in candidates], part.train, part.test, features, setting.target, setting.weight)
        if found is not None:
            return [(s, getattr(s, setting.score)) for s in found]
    if len(candidates) > 1 and setting.metric is None and all(
            c.family is regressors._kernel_ridge and c.scaling == candidates[0].scaling for c in candidates):
        found = kernel_search.scores(
            [c.params for c in candidates], candidates[0].scaling, part.train, part.test, features, setting.target, setting.weight)
        return [(s, getattr(s, setting.score)) for s in found]
    if len(candidates) > 1 and setting.metric is None and all(
            c.family is regressors._support_vectors and c.scaling == candidates[0].scaling for c in candidates):
        found = vector_search.scores(
            [c.params for c in candidates], candidates[0].scaling, part.train, part.test, features, setting.target, setting.weight)
        if found is not None:
            return [(s, getattr(s, setting.score)) for s in found]
    out: list[tuple[Scores, float]] = []
    for start in range(0, len(candidates), at_once):
        jobs = [lambda c=c: _fit(c, part, setting).table for c in candidates[start:start + at_once]]
        out += zip(*_scored(run_all(part.train.sparkSession, jobs, setting.parallelism), setting))
    return out


def validate_folds(regressor: Regressor, folded: DataFrame, setting: Setting) -> Validation:
    """Cross-validation of a table that has its ``fold`` column."""
    names = feature_columns(folded, setting.target, setting.bookkeeping)
    if by_algebra(regressor, folded, names, setting):
        with staging(folded.sparkSession) as stage:
            return SetValidator(regressor, folded, names, setting, stage).validate([{c: c for c in names}])[0]
    return validate_parts(regressor, fold_parts(folded, setting), setting)


def by_algebra(regressor: Regressor, folded: DataFrame, columns: Sequence[str], setting: Setting) -> bool:
    """Whether sums of products are enough: a linear model, numeric columns and a score of the library's own."""
    numeric = set(numeric_columns(folded))
    scaled = regressor.scaling in (None, "robust") or (regressor.scaling == "standard" and setting.weight is None)
    return regressor.linear and scaled and setting.metric is None and numeric >= {*columns, setting.target}


class SetValidator:
    """Cross-validation of feature sets over one folded, staged table.

    A set maps feature names to columns of the table. For linear models the passes over the table are shared by all
    sets, and what does not depend on a set is kept from one call to the next; others fit every set on its own
    projection.
    """

    def __init__(self, regressor: Regressor, folded: DataFrame, columns: Sequence[str], setting: Setting, stage: Callable[[DataFrame], DataFrame]):
        self.regressor, self.folded, self.setting, self.stage = regressor, folded, setting, stage
        self.algebra = None
        if by_algebra(regressor, folded, columns, setting):
            self.algebra = fold_algebra.FoldAlgebra(folded, columns, setting.target, setting.cv, regressor.scaling, setting.weight)

    def projection(self, features: Mapping[str, str]) -> DataFrame:
        keep = [c for c in (*self.setting.bookkeeping, self.setting.target) if c in self.folded.columns]
        return self.folded.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(n) for n, c in features.items()])

    def validate(self, sets: Sequence[Mapping[str, str]]) -> list[Validation]:
        if self.algebra is None:
            return [validate_folds(self.regressor, self.projection(s), self.setting) for s in sets]
        params, methods = self.regressor.params, methods_of(self.setting)
        columns = [list(s.values()) for s in sets]
        found = [self.algebra.scores(columns, m, params["alpha"], params["l1_ratio"], self.stage) for m in methods]
        return [
            _validation([(f, m, scores[s][f]) for f in range(self.setting.cv) for m, scores in zip(methods, found)], self.setting)
            for s in range(len(sets))]


def _validation(tried: Sequence[tuple], setting: Setting, chosen: Sequence[float] | None = None) -> Validation:
    """Summary of ``(fold, way of treating gaps, scores)``: in each fold the way of lowest score counts."""
    chosen = [getattr(s, setting.score) for _, _, s in tried] if chosen is None else chosen
    best = [
        min((i for i, t in enumerate(tried) if t[0] == fold), key=lambda i: (chosen[i], i))
        for fold in dict.fromkeys(t[0] for t in tried)]
    methods = Counter(tried[i][1] for i in best)
    return Validation(
        *(metrics.summarise([getattr(tried[i][2], n) for i in best]) for n in ("sigma", "eta", "score", "total")),
        preprocessing=methods.most_common(1)[0][0], chosen=metrics.summarise([chosen[i] for i in best]),
    )


def validate_parts(regressor: Regressor, parts: Sequence[Part], setting: Setting) -> Validation:
    """Cross-validation of parts that are preprocessed already; all fits share one pool."""
    spark = parts[0].train.sparkSession
    tried = run_all(spark, [lambda p=p: _fit(regressor, p, setting) for p in parts], setting.parallelism)
    scores, chosen = _scored([t.table for t in tried], setting)
    return _validation([(p.fold, p.method, s) for p, s in zip(parts, scores)], setting, chosen)
