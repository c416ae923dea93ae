"""Scores of many kernel ridges at once, from the sums that they share.

Scaling, landmarks and the products of all monomials do not depend on a point of the search: the Gram matrix of a degree is
a part of that of the highest degree in its primal form, and the kernel's parameters only scale its rows and columns.
Points on landmarks have a Gram matrix each, of which ``AT_ONCE`` are summed in one pass over the rows. One pass over
the test rows gives the answers of all points, and one set of passes their scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from skylattice.learn import kernels, regressors
from skylattice.learn.features import FEATURES
from skylattice.operators import metrics, scale
from skylattice.session import staging

#: Gram matrices on landmarks that a task sums at once, half a megabyte each.
AT_ONCE = 32


def _products(x: np.ndarray, powers: Sequence[tuple[int, ...]]) -> np.ndarray:
    """One column for each monomial, after a column of ones."""
    out, at = np.empty((len(x), len(powers) + 1), order="F"), {(0,) * x.shape[1]: 0}
    out[:, 0] = 1.0
    for k, p in sorted(enumerate(powers, 1), key=lambda kp: sum(kp[1])):
        f = next(i for i, e in enumerate(p) if e)
        out[:, k] = out[:, at[(*p[:f], p[f] - 1, *p[f + 1:])]] * x[:, f]
        at[p] = k
    return out


def scores(points: Sequence[dict], scaling: str | None, train: DataFrame, test: DataFrame, features: Sequence[str], target: str, weight: str | None) -> list[metrics.Scores]:
    """Scores of the kernel ridge of each point."""
    spark, inputs = train.sparkSession, len(features)
    fitted = scale.fit(train, features, scaling) if scaling else None
    table, asked = (regressors.fitting_table(t, features, target, weight if t is train else None, fitted) for t in (train, test))
    plain = [k for k, p in enumerate(points) if regressors.is_primal(inputs, p["degree"])]
    marked = [k for k in range(len(points)) if k not in set(plain)]
    powers = regressors.monomials(inputs, max((points[k]["degree"] for k in plain), default=0)) if plain else []
    place = {p: i for i, p in enumerate(powers, 1)}
    slopes, mapped = np.zeros((len(powers) + 1, len(plain))), []
    with staging(spark) as stage:
        rows = kernels.spread_rows(table, stage)
        if plain:
            def products(x, y, w):
                m = _products(x, powers)
                return np.hstack([(m * w[:, None]).T @ m, ((m * w[:, None]).T @ y)[:, None]])

            size = len(powers) + 1
            sums = kernels._sums(rows, size, products)
            sums = sums if sums.size else np.zeros((size, size + 1))
            for i, k in enumerate(plain):
                p = points[k]
                constant, factors = regressors.kernel_map_scales(inputs, p["degree"], p.get("gamma") or 1.0 / inputs, p["coef0"])
                at, d = [0, *(place[m] for m in regressors.monomials(inputs, p["degree"]))], np.array([constant, *factors])
                gram, right = sums[np.ix_(at, at)] * d[:, None] * d[None, :], sums[at, -1] * d
                slopes[at, i] = np.linalg.solve(gram + p["alpha"] * np.eye(len(at)), right) * d
        if marked:
            square = regressors.mean_square(table)
            most = {points[k].get("landmarks", kernels.LANDMARKS) for k in marked}
            marks = {m: kernels._rows_of_least_hash(table, m, 0) for m in most}
            kernel = [regressors.sized_kernel(points[k], inputs, square) for k in marked]
            maps = [kernels.map_of(marks[points[k].get("landmarks", kernels.LANDMARKS)], c) for k, c in zip(marked, kernel)]
            alphas = [regressors.sized_alpha(points[k], c) for k, c in zip(marked, kernel)]
            for start in range(0, len(maps), AT_ONCE):
                some = slice(start, start + AT_ONCE)
                found = kernels.ridges(rows, maps[some], alphas[some])
                mapped += [(marked[start + i], m, b) for i, (m, b) in enumerate(zip(maps[some], found))]
        sent = spark.sparkContext.broadcast((plain, powers, slopes, mapped))

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, powers, slopes, mapped = sent.value
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                told = [*zip(plain, (_products(x, powers) @ slopes).T)] if plain else []
                for k, guess in (*told, *((k, m.phi(x) @ b) for k, m, b in mapped)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, k, np.int32)), batch.column(1), pa.array(np.ascontiguousarray(guess))], ["point", "y_test", "y_pred"])

        wide = asked.select(vector_to_array(FEATURES).alias("x"), F.col("_label").alias("y"))
        spread = wide.repartition(spark.sparkContext.defaultParallelism)
        long = spread.mapInArrow(answers, "point int, y_test double, y_pred double")
        errors = stage(long.select("point", metrics.relative_error("y_test", "y_pred").alias("dz")))
        found = metrics.grouped_scores(errors, "point", "dz", len(points))
    return [found[k] for k in range(len(points))]
