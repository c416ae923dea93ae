"""Scores of many support vector regressions at once: each task fits whole points on rows that are sent to all.

Scaling, landmarks and rows are found once for all points of a search. This is for tables that take ``SHARED_BYTES`` at
most (rows are counted first); ``scores`` gives None for larger ones, whose points are fitted one by one by passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from skylattice.learn import forest_search, kernels, regressors
from skylattice.learn.features import FEATURES
from skylattice.operators import metrics, scale

#: Bytes of the rows that are sent to all tasks, at most: a million rows of six features.
SHARED_BYTES = 64 << 20


def _arrays(table: DataFrame, columns: int) -> tuple[np.ndarray, ...]:
    got = table.toArrow()
    x = got.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, columns)
    return x, *(got.column(i).to_numpy() for i in range(1, got.num_columns))


def scores(points: Sequence[dict], scaling: str | None, train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
           weight: str | None) -> list[metrics.Scores] | None:
    """Scores of the regression of each point, or None if a table is too large for this way."""
    spark, inputs = train.sparkSession, len(features)
    if max(train.count(), test.count()) * 8 * (inputs + 2) > SHARED_BYTES:
        return None
    points = [{**regressors.regressor("SVR").params, **p} for p in points]
    fitted = scale.fit(train, features, scaling) if scaling else None
    table, asked = (regressors.fitting_table(t, features, target, weight if t is train else None, fitted) for t in (train, test))
    drawn = [(p.get("landmarks", kernels.LANDMARKS), p.get("seed", 0)) for p in points]
    marks = {d: kernels._rows_of_least_hash(table, *d) for d in set(drawn)}
    # Bounded by SHARED_BYTES each.
    rows = _arrays(kernels.plain_rows(table), inputs)
    tested = _arrays(asked.select(vector_to_array(FEATURES).alias("x"), F.col("_label").alias("y")), inputs)
    sent = spark.sparkContext.broadcast((points, drawn, marks, rows, tested))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, drawn, marks, rows, (x, y) = sent.value
            for k in batch.column(0).to_pylist():
                p = points[k]
                mapped = kernels.map_of(marks[drawn[k]], kernels.Kernel("rbf", p.get("gamma") or 1.0 / inputs))
                found = kernels.support_vectors(kernels.HeldRows(*rows, mapped), mapped, p["C"], p.get("epsilon", 0.1))
                guess = np.concatenate([np.empty(0), *(
                    mapped.phi(x[a:a + kernels.HeldRows.BLOCK]) @ found.coefficients + found.offset for a in range(0, len(x), kernels.HeldRows.BLOCK))])
                yield pa.RecordBatch.from_pylist([dict(zip(("point", "sigma", "eta", "bias", "n"), (k, *forest_search._scores(y, guess))))], pa.schema(
                    [("point", pa.int32()), ("sigma", pa.float64()), ("eta", pa.float64()), ("bias", pa.float64()), ("n", pa.int64())]))

    # One point a task: they differ in what they cost.
    told = spark.range(0, len(points), 1, len(points)).mapInArrow(run, "point int, sigma double, eta double, bias double, n long")
    found = {r["point"]: metrics.Scores(r["sigma"], r["eta"], r["bias"], r["n"]) for r in told.collect()}
    return [found[k] for k in range(len(points))]
