"""Scores of redshift predictions: robust scatter, outlier rate and their combinations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators import order_stats

# The normal-consistency factor and the outlier limit.
MAD_FACTOR = 1.4826
OUTLIER_LIMIT = 0.15


@dataclass(frozen=True)
class Scores:
    """``sigma`` (NMAD), ``eta`` (outlier rate), ``bias`` (mean error) of one prediction set."""

    sigma: float
    eta: float
    bias: float
    rows: int

    @property
    def score(self) -> float:
        """Bias and scatter in quadrature."""
        return math.sqrt(self.bias**2 + self.sigma**2)

    @property
    def total(self) -> float:
        """Scatter plus outlier rate."""
        return self.sigma + self.eta


def relative_error(truth: str = "y_test", prediction: str = "y_pred") -> Column:
    return (F.col(truth) - F.col(prediction)) / F.nullif(F.lit(1.0) + F.col(truth), F.lit(0.0))


def scores(df: DataFrame, truth: str = "y_test", prediction: str = "y_pred") -> Scores:
    return scores_by(df.withColumn("_all", F.lit(0)), "_all", [0], truth, prediction)[0]


def scores_by(
    df: DataFrame, group: str, values: list, truth: str = "y_test", prediction: str = "y_pred"
) -> dict:
    """Scores per value of a small grouping column such as the fold.

    Each group becomes a column of its own, so the exact medians of all groups share passes.
    """
    dz = relative_error(truth, prediction)
    errors = df.select(*[F.when(F.col(group) == F.lit(v), dz).alias(f"e{i}") for i, v in enumerate(values)])
    names = errors.columns
    sums = []
    for n in names:
        sums += [
            F.avg(n).alias(f"{n}_bias"),
            F.avg(F.when(F.abs(n) > OUTLIER_LIMIT, 1.0).when(F.col(n).isNotNull(), 0.0)).alias(f"{n}_eta"),
            F.count(F.when(present(F.col(n)), 1)).alias(f"{n}_rows"),
        ]
    simple = errors.agg(*sums).first()
    counts = {n: simple[f"{n}_rows"] for n in names}
    middle = order_stats.medians(errors, names, counts=counts)
    known = [n for n in names if middle[n] is not None]
    spread = order_stats.medians(
        errors.select(*[F.abs(F.col(n) - F.lit(middle[n])).alias(n) for n in known]), known, counts=counts
    ) if known else {}
    result = {}
    for n, v in zip(names, values):
        if n not in spread:
            raise ValueError(f"no predictions for {group} = {v}")
        result[v] = Scores(MAD_FACTOR * spread[n], simple[f"{n}_eta"], simple[f"{n}_bias"], simple[f"{n}_rows"])
    return result


def grouped_scores(df: DataFrame, group: str, dz: str, groups: int) -> dict[int, Scores]:
    """Scores of many prediction sets, from a long table of a set's number and a relative error.

    All sets share the passes, however many there are.
    """
    error = F.col(dz)
    simple = {r["g"]: r for r in df.where(error.isNotNull()).groupBy(F.col(group).cast("int").alias("g")).agg(
        F.avg(error).alias("bias"), F.avg(F.when(F.abs(error) > OUTLIER_LIMIT, 1.0).otherwise(0.0)).alias("eta"),
        F.count(F.when(present(error), 1)).alias("n")).collect()}
    for g in range(groups):
        if g not in simple or not simple[g]["n"]:
            raise ValueError(f"no predictions for {group} = {g}")
    counts = {g: r["n"] for g, r in simple.items()}
    middle = order_stats.grouped_medians(df, group, dz, counts)
    centres = F.array(*[F.lit(middle[g]) for g in range(groups)])
    away = df.select(group, F.abs(error - F.get(centres, F.col(group).cast("int"))).alias("_away"))
    spread = order_stats.grouped_medians(away, group, "_away", counts)
    return {g: Scores(MAD_FACTOR * spread[g], simple[g]["eta"], simple[g]["bias"], counts[g]) for g in range(groups)}


def block_scores(df: DataFrame, blocks: order_stats.Blocks, groups: int) -> dict[int, Scores]:
    """As :func:`grouped_scores`, for sets whose errors stand side by side in the rows, NaN where a row has none."""
    simple = order_stats.block_sums(df, blocks, groups, OUTLIER_LIMIT)
    for g in range(groups):
        if g not in simple:
            raise ValueError(f"no predictions for {g}")
    counts = {g: simple[g]["n"] for g in range(groups)}
    middle = order_stats.block_medians(df, blocks, counts, simple)
    centres = np.array([middle[g] for g in range(groups)])

    def away(batch):
        return ((g, np.abs(x - centres[g])) for g, x in blocks(batch))

    spread = order_stats.block_medians(df, away, counts)
    return {g: Scores(MAD_FACTOR * spread[g], simple[g]["far"] / counts[g], simple[g]["total"] / counts[g], counts[g]) for g in range(groups)}


@dataclass(frozen=True)
class Summary:
    """Mean over folds and its error, population deviation over the root of the fold count."""

    mean: float
    error: float


def summarise(values: list[float]) -> Summary:
    k = len(values)
    mean = sum(values) / k
    return Summary(mean, math.sqrt(sum((v - mean) ** 2 for v in values) / k) / math.sqrt(k))
