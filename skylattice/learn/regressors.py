"""The regressors by name, each a preset over ``pyspark.ml`` or over a Spark aggregate.

A :class:`Regressor` says how to scale and what to fit; :meth:`Regressor.fit` returns a
:class:`Fitted` that adds ``y_pred`` to any table with the same feature columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from skylattice.learn import kernels, trees
from skylattice.learn.features import FEATURES, assemble
from skylattice.operators import scale
from skylattice.session import staging

LABEL, PREDICTION, WEIGHT = "y_test", "y_pred", "_weight"
#: Columns of a kernel's explicit map, at most: its Gram matrix, of their square, is summed in every task. Wider ones go by landmarks.
MAX_MAP_WIDTH = 1000
#: Bins of a feature in trees whose preset names none.
MAX_BINS = 256


@dataclass(frozen=True)
class Fitted:
    features: tuple[str, ...]
    scaling: scale.Scaling | None
    predictor: Callable[[DataFrame], DataFrame]

    def predict(self, df: DataFrame) -> DataFrame:
        """The table with a ``y_pred`` column."""
        columns = df.columns
        raw = _feature_table(df, self.features, self.scaling)
        return self.predictor(raw).select(*[F.col(f"`{c}`") for c in columns], PREDICTION)


@dataclass(frozen=True)
class Regressor:
    name: str
    family: Callable[[DataFrame, dict, bool, int], Callable[[DataFrame], DataFrame]]
    params: dict = field(default_factory=dict)
    scaling: str | None = None

    @property
    def linear(self) -> bool:
        """Whether coefficients follow from sums of products alone."""
        return self.family is _linear

    def with_params(self, **params) -> "Regressor":
        return replace(self, params={**self.params, **params})

    def fit(self, train: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> Fitted:
        """Fit on complete rows; a row without a weight takes no part in a weighted fit."""
        scaling = scale.fit(train, features, self.scaling) if self.scaling else None
        table = fitting_table(train, features, target, weight, scaling)
        return Fitted(tuple(features), scaling, self.family(table, dict(self.params), weight is not None, len(features)))


def fitting_table(df: DataFrame, features: Sequence[str], target: str, weight: str | None, scaling: scale.Scaling | None = None) -> DataFrame:
    """Feature vector, label and weight of each row; no weight counts as nought in a weighted fit."""
    table = _feature_table(df, features, scaling).withColumn("_label", F.col(f"`{target}`").cast("double"))
    w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return table.select(FEATURES, "_label", w.alias(WEIGHT))


def _feature_table(df: DataFrame, features: Sequence[str], scaling: scale.Scaling | None) -> DataFrame:
    # scaled copies under plain names: feature names may hold blanks and dots
    inputs = []
    for i, c in enumerate(features):
        value = F.col(f"`{c}`").cast("double")
        if scaling:
            value = (value - F.lit(scaling.centre[c])) / F.lit(scaling.spread[c])
        inputs.append(value.alias(f"_f{i}"))
    return assemble([f"_f{i}" for i in range(len(features))]).transform(df.select("*", *inputs))


def _estimate(estimator, table: DataFrame, weighted: bool):
    estimator = estimator.setFeaturesCol(FEATURES).setLabelCol("_label").setPredictionCol(PREDICTION)
    return (estimator.setWeightCol(WEIGHT) if weighted else estimator).fit(table)


def _share(rule: str, inputs: int) -> float:
    """Share of the features that a rule allows."""
    return {"all": 1.0, "sqrt": math.sqrt(inputs) / inputs}.get(rule) or float(rule)


def forest_growth(params: dict, inputs: int) -> trees.Growth:
    return trees.Growth(
        depth=params["maxDepth"], least_split=params.get("minRowsToSplit", 2), least_leaf=params.get("minInstancesPerNode", 1),
        node_features=_share(params.get("featureSubsetStrategy", "all"), inputs), bootstrap=params.get("bootstrap", True),
        absolute=params.get("criterion", "squared") == "absolute", seed=params.get("seed", 0))


def _forest(table, params, weighted, inputs):
    growth = forest_growth(params, inputs)
    with staging(table.sparkSession) as stage:
        model = trees.forest(table, params["numTrees"], growth, params.get("maxBins", MAX_BINS), inputs, stage)
    return lambda df: model.transform(df, PREDICTION)


def _boosting(table, params, weighted, inputs):
    share = _share(params.get("featureSubsetStrategy", "all"), inputs)
    growth = trees.Growth(
        depth=params.get("maxDepth", trees.NO_LIMIT), leaves=params.get("leaves"), least_leaf=params.get("minInstancesPerNode", 1),
        least_hessian=params.get("leastHessian", 0.0), ridge=params.get("ridge", 0.0), least_gain=params.get("leastGain", 0.0),
        **{"tree_features" if params.get("featuresByTree") else "node_features": share},
        rows=params.get("subsamplingRate", 1.0), redraw=params.get("redraw", 1), seed=params.get("seed", 0))
    with staging(table.sparkSession) as stage:
        model = trees.boosted(table, params["maxIter"], params["stepSize"], growth, params.get("maxBins", MAX_BINS), inputs, stage,
                              params.get("base"), params.get("weightedBins", False))
    return lambda df: model.transform(df, PREDICTION)


def _linear(table, params, weighted, inputs):
    """Elastic net with penalty ``alpha * (l1 * |b| + (1 - l1) / 2 * b^2)``.

    Spark works on a label of unit deviation, which leaves the L1 part as it is and divides the
    squared part by that deviation.
    """
    alpha, l1 = params["alpha"], params["l1_ratio"]
    spread = 1.0
    if l1 < 1.0:
        spread = _label_deviation(table)
    total = alpha * (l1 + (1.0 - l1) * spread)
    share = alpha * l1 / total if total else 0.0
    model = _estimate(
        LinearRegression(regParam=total, elasticNetParam=share, standardization=False,
                         maxIter=params.get("maxIter", 500), tol=params.get("tol", 1e-9)),
        table, weighted,
    )
    return model.transform


def _label_deviation(table: DataFrame) -> float:
    """Weighted sample deviation of the label."""
    w, y = F.col(WEIGHT), F.col("_label")
    row = table.agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy")).first()
    mean = row["wy"] / row["w"]
    return math.sqrt(max(row["wyy"] / row["w"] - mean * mean, 0.0) * row["w"] / (row["w"] - row["ww"] / row["w"]))


def monomials(inputs: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents in the order of Spark's polynomial expansion."""
    powers: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == inputs:
            powers.append(prefix)
            return
        for e in range(left + 1):
            grow(prefix + (e,), left - e)

    grow((), degree)
    powers.remove((0,) * inputs)
    return sorted(powers, key=lambda p: p[::-1])


def kernel_map_scales(inputs: int, degree: int, gamma: float, coef0: float) -> tuple[float, np.ndarray]:
    """Factors that turn monomials into the explicit map of ``(gamma x.y + coef0) ** degree``."""
    factors = []
    for p in monomials(inputs, degree):
        m = sum(p)
        ways = math.factorial(degree) / math.factorial(degree - m) / math.prod(math.factorial(e) for e in p)
        factors.append(math.sqrt(ways * gamma**m * coef0 ** (degree - m)))
    return math.sqrt(coef0**degree), np.array(factors)


def is_primal(inputs: int, degree: int) -> bool:
    """Whether the explicit map of a degree is narrow enough."""
    return math.comb(inputs + degree, degree) <= MAX_MAP_WIDTH


def _kernel_ridge(table, params, weighted, inputs):
    """Polynomial kernel ridge in its primal form.

    The weighted Gram matrix of the explicit map is summed per task and then by row across tasks;
    only this matrix, whose size depends on the number of features, reaches the driver.
    """
    degree, alpha, coef0 = params["degree"], params["alpha"], params["coef0"]
    if not is_primal(inputs, degree):
        return _landmark_ridge(table, params, inputs)
    gamma = params.get("gamma") or 1.0 / inputs
    constant, factors = kernel_map_scales(inputs, degree, gamma, coef0)
    expansion = PolynomialExpansion(degree=degree, inputCol=FEATURES, outputCol="_poly")
    mapped = expansion.transform(table).select(
        vector_to_array("_poly").alias("x"), F.col("_label").alias("y"), F.col(WEIGHT).alias("w")
    )

    def partial(batches):
        size = len(factors) + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if not len(batch):
                continue
            phi = np.hstack([np.full((len(batch), 1), constant), np.stack(batch["x"].to_numpy()) * factors])
            weighted_phi = phi * batch["w"].to_numpy()[:, None]
            total[:, :-1] += weighted_phi.T @ phi
            total[:, -1] += weighted_phi.T @ batch["y"].to_numpy()
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    rows = mapped.mapInPandas(partial, "i int, row array<double>")
    # two levels: the few keys of the last sum meet sums of whole groups of tasks
    grouped = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("i", "_part").agg(
        Summarizer.sum(array_to_vector("row")).alias("row"))
    summed = grouped.groupBy("i").agg(Summarizer.sum(F.col("row")).alias("row"))
    gram = np.array([r["row"].toArray() for r in summed.orderBy("i").collect()])
    solution = np.linalg.solve(gram[:, :-1] + alpha * np.eye(len(gram)), gram[:, -1])
    offset, slopes = float(solution[0] * constant), (solution[1:] * factors).tolist()
    weights = F.array(*[F.lit(v) for v in slopes])

    def predict(df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array("_poly"), weights, lambda a, b: a * b)
        return expansion.transform(df).withColumn(
            PREDICTION, F.aggregate(terms, F.lit(offset), lambda s, t: s + t)
        )
    return predict


def mean_square(table: DataFrame) -> float:
    """Mean square length of the rows."""
    return table.agg(F.avg(F.aggregate(F.transform(vector_to_array(FEATURES), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0


def sized_kernel(params: dict, inputs: int, square: float) -> kernels.Kernel:
    """The kernel divided by a power of the rows' mean size: high degrees stay finite, the answers stay the same."""
    gamma = params.get("gamma") or 1.0 / inputs
    return kernels.Kernel("polynomial", gamma, params["degree"], params["coef0"], max(gamma * square + params["coef0"], 1e-300))


def sized_alpha(params: dict, kernel: kernels.Kernel) -> float:
    """The penalty that a kernel divided by its size asks for."""
    return params["alpha"] / kernel.size**kernel.degree if kernel.degree * math.log10(kernel.size) < 300 else 0.0


def _landmark_ridge(table, params, inputs):
    """Kernel ridge of a degree whose explicit map would be too wide, on landmarks."""
    kernel = sized_kernel(params, inputs, mean_square(table))
    with staging(table.sparkSession) as stage:
        rows = kernels.spread_rows(table, stage)
        mapped = kernels.landmark_map(table, kernel, params.get("landmarks", kernels.LANDMARKS))
        found = kernels.ridge(rows, mapped, sized_alpha(params, kernel))
    return kernels.predictor(mapped, found, 0.0, PREDICTION)


def _support_vectors(table, params, weighted, inputs):
    """Radial-basis regression with the epsilon-insensitive loss, on landmarks."""
    kernel = kernels.Kernel("rbf", params.get("gamma") or 1.0 / inputs)
    with staging(table.sparkSession) as stage:
        rows = kernels.spread_rows(table, stage)
        mapped = kernels.landmark_map(table, kernel, params.get("landmarks", kernels.LANDMARKS), params.get("seed", 0))
        found = kernels.support_vectors(rows, mapped, params["C"], params.get("epsilon", 0.1))
    return kernels.predictor(mapped, found.coefficients, found.offset, PREDICTION)


# The presets of the regressors.
REGRESSORS: dict[str, Regressor] = {
    "RF": Regressor("RF", _forest, {"numTrees": 86, "maxDepth": 11, "featureSubsetStrategy": "all", "seed": 0}),
    "GBR": Regressor("GBR", _boosting, {
        "maxIter": 3000, "stepSize": 0.05, "maxDepth": 4, "featureSubsetStrategy": "sqrt", "seed": 0}),
    "XGB": Regressor("XGB", _boosting, {
        "maxIter": 2200, "stepSize": 0.3, "maxDepth": 3, "ridge": 1.0, "leastHessian": 1.0, "base": 0.5, "weightedBins": True, "seed": 0}),
    "LGB": Regressor("LGB", _boosting, {
        "maxIter": 720, "stepSize": 0.05, "leaves": 5, "maxBins": 55, "subsamplingRate": 0.8, "redraw": 5,
        "featureSubsetStrategy": "0.2319", "featuresByTree": True, "minInstancesPerNode": 6, "leastHessian": 11.0, "seed": 9}),
    "LASSO": Regressor("LASSO", _linear, {"alpha": 0.0005, "l1_ratio": 1.0}, "robust"),
    "ENET": Regressor("ENET", _linear, {"alpha": 0.0005, "l1_ratio": 0.9}, "robust"),
    "KRR": Regressor("KRR", _kernel_ridge, {"degree": 2, "alpha": 0.6, "coef0": 2.5}, "standard"),
    "SVR": Regressor("SVR", _support_vectors, {"C": 1.0, "epsilon": 0.1}, "standard"),
}


def regressor(name: str) -> Regressor:
    if name not in REGRESSORS:
        raise ValueError(f"unknown regressor {name!r}, choose one of {sorted(REGRESSORS)}")
    return REGRESSORS[name]
