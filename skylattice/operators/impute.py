"""Missing-value handling of a training table.

Statistics are fitted on the train part and applied to both parts; fitting each part on its
own data is possible by calling :func:`fit` twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators import order_stats
from skylattice.operators.project import numeric_columns, training_sentinels
from skylattice.operators.statistics import missing_shares

METHODS = ("drop", "mean", "mode", "median")
SPARSE_PERCENT = 15.0


@dataclass(frozen=True)
class Imputation:
    method: str | float | None
    columns: tuple[str, ...]
    dropped: tuple[str, ...] = ()
    fills: dict[str, float] = field(default_factory=dict)


def check_method(method) -> None:
    number = isinstance(method, (int, float)) and not isinstance(method, bool)
    if method is not None and method not in METHODS and not number:
        raise ValueError(f"method must be None, a number or one of {METHODS}, got {method!r}")


def sparse_columns(df: DataFrame, columns: Sequence[str], limit: float = SPARSE_PERCENT) -> list[str]:
    """Columns with more than ``limit`` percent missing values."""
    found = {r["column"] for r in missing_shares(df, columns).filter(F.col("missing_percent") > limit).collect()}
    return [c for c in columns if c in found]


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Most frequent value per column, the smallest one on a tie.

    Values are counted in a distributed group-by; only the winners reach the driver.
    """
    cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .filter(present(F.col("v")))
        .groupBy("i", "v")
        .agg((-F.count(F.lit(1))).alias("n"))
    )
    best = counted.groupBy("i").agg(F.min(F.struct("n", "v")).alias("b")).collect()
    found = {columns[r["i"]]: r["b"]["v"] for r in best}
    return {c: found.get(c) for c in columns}


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(F.when(present(F.col(f"`{c}`")), F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def fit(
    train: DataFrame, method: str | float | None, columns: Sequence[str] | None = None,
    keep: Sequence[str] = (), protect: Sequence[str] = (),
) -> Imputation:
    """Learn what to drop and what to fill in from the train part.

    ``columns`` defaults to all numeric columns; those in ``keep`` (keys, folds, weights) are left
    alone, those in ``protect`` (the target) are treated but never dropped as sparse.
    """
    check_method(method)
    columns = [c for c in (columns or numeric_columns(train)) if c not in set(keep)]
    if method is None:
        return Imputation(None, tuple(columns))
    clean = training_sentinels(train, columns)
    dropped = [c for c in sparse_columns(clean, columns) if c not in set(protect)]
    rest = [c for c in columns if c not in dropped]
    if method == "drop":
        fills: dict[str, float | None] = {}
    elif method == "mean":
        fills = means(clean, rest)
    elif method == "mode":
        fills = modes(clean, rest)
    elif method == "median":
        fills = order_stats.medians(clean, rest)
    else:
        fills = {c: float(method) for c in rest}
    return Imputation(method, tuple(columns), tuple(dropped), {c: v for c, v in fills.items() if v is not None})


def apply(df: DataFrame, plan: Imputation) -> DataFrame:
    if plan.method is None:
        return df
    df = training_sentinels(df, plan.columns).drop(*plan.dropped)
    if plan.method == "drop":
        return df.dropna("any", subset=[c for c in plan.columns if c not in plan.dropped])
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in plan.fills.items()}
    return df.withColumns(filled) if filled else df


def check_complete(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a value is still missing."""
    left = [r["column"] for r in missing_shares(df, columns).filter("missing_percent > 0").collect()]
    if left:
        raise ValueError(f"missing values remain in {sorted(left)}")


def preprocess(
    train: DataFrame, test: DataFrame, method: str | float | None,
    keep: Sequence[str] = (), protect: Sequence[str] = (), fit_each: bool = False,
) -> tuple[DataFrame, DataFrame, Imputation]:
    """Both parts without missing values, and the plan fitted on the train part."""
    plan = fit(train, method, keep=keep, protect=protect)
    if plan.method is None:
        return train, test, plan
    other = plan
    if fit_each:
        own = fit(test, method, keep=keep, protect=protect)
        # a column leaves both parts or none, otherwise a model could not read the test part
        gone = tuple(dict.fromkeys(plan.dropped + own.dropped))
        plan = Imputation(method, plan.columns, gone, {c: v for c, v in plan.fills.items() if c not in gone})
        other = Imputation(method, own.columns, gone, {c: v for c, v in own.fills.items() if c not in gone})
    train, test = apply(train, plan), apply(test, other)
    rest = [c for c in plan.columns if c not in plan.dropped]
    check_complete(train.select(*[f"`{c}`" for c in rest]).unionByName(test.select(*[f"`{c}`" for c in rest])), rest)
    return train, test, plan
