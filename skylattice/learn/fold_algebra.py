"""Cross-validation of linear models by algebra on sums of products, for many feature sets at once.

One pass sums, for each fold, the products of all columns that any feature set may use. Leaving a fold out is a
subtraction, a set of features a minor of the matrix, filling gaps and scaling linear maps of it: a column with gaps is
split into its values (nought in gaps) and a column that marks the gaps, so any filling is their sum with a factor. Each
fit is then a coordinate descent on a matrix of the set's size. Predictions of all fits are made in one pass and scored in a few
more. So the passes over the table do not depend on the number of sets or folds, and neither does what a task sends:
one matrix a fold.

Products are summed around the columns' means, so large values cost no precision. Where rows with gaps are
dropped, fits that drop the same rows share a matrix; a table without gaps has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators import impute, metrics, order_stats
from skylattice.operators.metrics import Scores
from skylattice.operators.project import training_sentinels

#: Sweeps of the coordinate descent, and the relative change at which it ends.
SWEEPS, PRECISION = 200_000, 1e-14


def elastic_net(c: np.ndarray, r: np.ndarray, alpha: float, l1: float) -> np.ndarray:
    """Least ``b c b / 2 - r b + alpha (l1 |b| + (1 - l1) / 2 b^2)`` for covariances ``c`` and ``r``.

    Descent by coordinates finds the coefficients that are not nought and their signs; the equations that then
    hold are solved at once and taken if they agree with those signs.
    """
    ridge, lasso = alpha * (1 - l1), alpha * l1
    full = c + ridge * np.eye(len(r))
    if not lasso:
        return np.linalg.lstsq(full, r, rcond=None)[0]
    b, diagonal = np.zeros(len(r)), np.diag(full).copy()
    live = np.flatnonzero(diagonal > 0)
    for _ in range(SWEEPS):
        change = 0.0
        for j in live:
            rho = r[j] - full[j] @ b + diagonal[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - lasso, 0.0) / diagonal[j]
            change = max(change, abs(new - b[j]) * diagonal[j] ** 0.5)
            b[j] = new
        if change <= PRECISION * max(1e-300, np.abs(b * diagonal ** 0.5).max(initial=0.0)):
            break
    some = np.flatnonzero(b)
    if len(some):
        exact = np.linalg.lstsq(full[np.ix_(some, some)], r[some] - lasso * np.sign(b[some]), rcond=None)[0]
        if (np.sign(exact) == np.sign(b[some])).all():
            b[some] = exact
    return b


@dataclass
class _Moments:
    """What one set of rows gives: fillings and scales by fold left out, and sums of products by fold."""

    fill: np.ndarray  # fold, column
    spread: np.ndarray  # fold, column
    gram: np.ndarray  # fold, 1 + 2 * column, same
    pivot: np.ndarray  # column

    def model(self, fold: int, columns: list[int], target: int, alpha: float, l1: float) -> np.ndarray | None:
        """Factors of one, values and gap marks in the prediction of a fold from the others."""
        count = self.fill.shape[1]
        gram = self.gram.sum(axis=0) - self.gram[fold]
        # Rows of the map: one, the filled features, the filled target.
        rows = np.zeros((len(columns) + 2, len(gram)))
        rows[0, 0] = 1.0
        for k, j in enumerate([*columns, target], start=1):
            rows[k, 1 + j], rows[k, 1 + count + j] = 1.0, self.fill[fold, j]
        m = rows @ gram @ rows.T
        if not m[0, 0] > 0:
            return None
        mean = m[0] / m[0, 0]
        cov = m / m[0, 0] - np.outer(mean, mean)
        scale = self.spread[fold, columns]
        inner = slice(1, len(columns) + 1)
        b = elastic_net(cov[inner, inner] / np.outer(scale, scale), cov[inner, -1] / scale, alpha, l1) / scale
        out = b @ rows[inner]
        out[0] = mean[-1] - b @ mean[inner]
        return out


class FoldAlgebra:
    """Scores of linear fits on feature sets of ``table``, which has its ``fold`` column and is read a few times.

    ``columns`` are all columns that sets may use; ``weight`` counts rows in the fits only.
    """

    def __init__(self, table: DataFrame, columns: Sequence[str], target: str, cv: int, scaling: str | None, weight: str | None = None):
        self.table, self.columns, self.target, self.cv, self.scaling, self.weight = table, [*dict.fromkeys(columns), target], target, cv, scaling, weight
        self.number = {c: i for i, c in enumerate(self.columns)}
        self._known: dict[tuple, _Moments] = {}
        self._counted: dict[tuple, tuple] = {}

    # --- the rows ---------------------------------------------------------------------------

    def _rows(self, method, mask: frozenset[int]) -> DataFrame:
        """``fold, w, v0..`` with NULL in gaps, of rows without gaps in the columns of the mask."""
        clean = training_sentinels(self.table, self.columns) if method is not None else self.table
        w = F.coalesce(F.col(f"`{self.weight}`").cast("double"), F.lit(0.0)) if self.weight else F.lit(1.0)
        values = [F.col(f"`{c}`").cast("double") for c in self.columns]
        rows = clean.select(F.col("fold").cast("int").alias("fold"), w.alias("w"), *[F.when(present(v), v).alias(f"v{i}") for i, v in enumerate(values)])
        return rows.dropna("any", subset=[f"v{i}" for i in sorted(mask)]) if mask else rows

    def _counts(self, method, mask: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by fold; present values and their sums by fold and column."""
        key = (method is not None, mask)
        if key not in self._counted:
            n, present_, sums = np.zeros(self.cv), np.zeros((self.cv, len(self.columns))), np.zeros((self.cv, len(self.columns)))
            each = [f(f"v{i}").alias(f"{a}{i}") for i in range(len(self.columns)) for a, f in (("c", F.count), ("s", F.sum))]
            for r in self._rows(method, mask).groupBy("fold").agg(F.count("*").alias("n"), *each).collect():
                n[r["fold"]] = r["n"]
                present_[r["fold"]] = [r[f"c{i}"] for i in range(len(self.columns))]
                sums[r["fold"]] = [r[f"s{i}"] or 0.0 for i in range(len(self.columns))]
            self._counted[key] = n, present_, sums
        return self._counted[key]

    def _by_train(self, fill: np.ndarray) -> order_stats.Blocks:
        """Each value once for every fold that it helps to fit, gaps filled; a group's number tells fold and column."""
        count, cv = len(self.columns), self.cv

        def blocks(batch: pa.RecordBatch):
            fold, values = _values(batch, count)
            for f in range(cv):
                part = values[fold != f]
                yield f * count + np.arange(count), np.where(np.isnan(part), fill[f], part)

        return blocks

    def _fills(self, method, rows: DataFrame, n: np.ndarray, have: np.ndarray, sums: np.ndarray) -> np.ndarray:
        train, total = have.sum(axis=0) - have, sums.sum(axis=0) - sums
        gaps = have.sum() < n.sum() * len(self.columns)
        if method in (None, "drop") or not gaps:
            return np.zeros(have.shape)
        if method == "mean":
            return np.divide(total, train, out=np.full(have.shape, np.nan), where=train > 0)
        if method == "mode":
            found = np.full(have.shape, np.nan)
            cells = [F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in range(len(self.columns))]
            counted = rows.select("fold", F.inline(F.array(*cells))).where("v IS NOT NULL").groupBy("i", "v").agg(
                *[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in range(self.cv)])
            best = counted.groupBy("i").agg(*[F.min(F.when(F.col(f"n{f}") > 0, F.struct((-F.col(f"n{f}")).alias("n"), "v"))).alias(f"b{f}") for f in range(self.cv)])
            for r in best.collect():
                found[:, r["i"]] = [r[f"b{f}"]["v"] if r[f"b{f}"] else np.nan for f in range(self.cv)]
            return found
        if method == "median":
            counts = {f * len(self.columns) + i: int(train[f, i]) for f in range(self.cv) for i in range(len(self.columns))}
            found = order_stats.block_medians(rows, self._by_train(np.full(have.shape, np.nan)), counts)
            return np.array([found.get(g, np.nan) for g in sorted(counts)]).reshape(have.shape)
        return np.full(have.shape, float(method))

    def _moments(self, method, mask: frozenset[int]) -> _Moments:
        """Statistics of the rows that a mask leaves; a few passes, once for each way of treating gaps and mask."""
        if (method, mask) in self._known:
            return self._known[method, mask]
        rows = self._rows(method, mask)
        n, have, sums = self._counts(method, mask)
        fill = self._fills(method, rows, n, have, sums)
        spread = np.ones(have.shape)
        if self.scaling == "robust":
            filled = np.full(have.shape, np.nan) if method in (None, "drop") else fill
            train, whole = have.sum(axis=0) - have, (n.sum() - n)[:, None] + 0 * have
            counts = train if method in (None, "drop") else np.where(np.isnan(fill), train, whole)
            found = order_stats.block_quantiles(rows, self._by_train(filled), (0.25, 0.75), {g: int(c) for g, c in enumerate(counts.ravel())})
            for g, (low, high) in found.items():
                spread.flat[g] = (high - low) or 1.0
        pivot = np.divide(sums.sum(axis=0), have.sum(axis=0), out=np.zeros(len(self.columns)), where=have.sum(axis=0) > 0)
        gram = self._gram(rows, pivot)
        found = _Moments(np.nan_to_num(fill - pivot), spread, gram, pivot)
        self._known[method, mask] = found
        return found

    def _gram(self, rows: DataFrame, pivot: np.ndarray) -> np.ndarray:
        """Weighted sums of products of one, shifted values and gap marks, for each fold."""
        size, cv = 1 + 2 * len(pivot), self.cv

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cv, size, size))
            for batch in batches:
                fold, z = _expanded(batch, pivot)
                w = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                for f in np.unique(fold):
                    part = z[fold == f]
                    total[f] += (part * w[fold == f]).T @ part
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(cv), size), pa.int32()), pa.array(np.tile(np.arange(size), cv), pa.int32()),
                pa.array(list(total.reshape(-1, size)), pa.list_(pa.float64()))], ["fold", "i", "row"])

        sent = rows.mapInArrow(partial, "fold int, i int, row array<double>")
        # two levels: the few keys of the last sum meet sums of whole groups of tasks
        grouped = sent.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("fold", "i", "_part").agg(
            Summarizer.sum(array_to_vector("row")).alias("row"))
        gram = np.zeros((cv, size, size))
        for r in grouped.groupBy("fold", "i").agg(Summarizer.sum(F.col("row")).alias("row")).collect():
            gram[r["fold"], r["i"]] = r["row"].toArray()
        return gram

    # --- fits and scores --------------------------------------------------------------------

    def _standard(self, moments: _Moments, fold: int, columns: list[int]) -> None:
        gram, count = moments.gram.sum(axis=0) - moments.gram[fold], moments.fill.shape[1]
        for j in columns:
            row = np.zeros(len(gram))
            row[1 + j], row[1 + count + j] = 1.0, moments.fill[fold, j]
            mean, square = gram[0] @ row / gram[0, 0], row @ gram @ row / gram[0, 0]
            moments.spread[fold, j] = np.sqrt(max(square - mean * mean, 0.0)) or 1.0

    def scores(self, sets: Sequence[Sequence[str]], method, alpha: float, l1: float, stage: Callable[[DataFrame], DataFrame]) -> list[list[Scores]]:
        """Scores of each set in each fold; ``stage`` writes the table of errors, which is read several times."""
        impute.check_method(method)
        n, have, _ = self._counts(method)
        missing = np.divide((n - have.T).sum(axis=1)[:, None] - (n - have.T), (n.sum() - n)[None, :])  # column, fold
        target = self.number[self.target]
        gappy = frozenset(np.flatnonzero(have.sum(axis=0) < n.sum()).tolist())
        jobs: dict[frozenset[int], list[tuple[int, int, list[int]]]] = {}
        for s, names in enumerate(sets):
            for f in range(self.cv):
                kept = [self.number[c] for c in names if method is None or not missing[self.number[c], f] * 100 > impute.SPARSE_PERCENT]
                mask = gappy & {*kept, target} if method == "drop" else frozenset()
                jobs.setdefault(mask, []).append((s, f, kept))
                if method is None and gappy & {*kept, target}:
                    raise ValueError(f"missing values remain in {sorted(self.columns[i] for i in gappy & {*kept, target})}")
        found: dict[tuple[int, int], Scores] = {}
        for mask, part in jobs.items():
            found |= self._scored(method, mask, part, alpha, l1, stage)
        return [[found[s, f] for f in range(self.cv)] for s in range(len(sets))]

    def _scored(self, method, mask, part, alpha, l1, stage) -> dict[tuple[int, int], Scores]:
        moments, target = self._moments(method, mask), self.number[self.target]
        number = {s: k for k, s in enumerate(dict.fromkeys(s for s, _, _ in part))}
        factors = np.full((self.cv, len(number), moments.gram.shape[1]), np.nan)
        for s, f, kept in part:
            if self.scaling == "standard":
                self._standard(moments, f, kept)
            model = moments.model(f, kept, target, alpha, l1)
            if model is not None:
                factors[f, number[s]] = model
        pivot, fill = moments.pivot, moments.fill[:, target] + moments.pivot[target]
        sent = self.table.sparkSession.sparkContext.broadcast((factors, pivot, fill))

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factors, pivot, fill = sent.value
            for batch in batches:
                fold, z = _expanded(batch, pivot)
                y = batch.column(2 + target).to_numpy(zero_copy_only=False).astype(float)
                y = np.where(np.isnan(y), fill[fold], y)
                dz = np.full((len(fold), factors.shape[1]), np.nan)
                for f in np.unique(fold):
                    here = fold == f
                    guess = z[here] @ np.nan_to_num(factors[f]).T + pivot[target]
                    guess[:, np.isnan(factors[f, :, 0])] = np.nan
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dz[here] = (y[here, None] - guess) / np.where(y[here] == -1.0, np.nan, 1.0 + y[here])[:, None]
                ends = np.arange(0, dz.size + 1, dz.shape[1], np.int32) if dz.size else np.zeros(len(dz) + 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(dz.ravel()))], ["fold", "dz"])

        table = stage(self._rows(method, mask).mapInArrow(errors, "fold int, dz array<double>"))
        order = {number[s] * self.cv + f: (s, f) for s, f, _ in part}
        dense = {g: k for k, g in enumerate(sorted(order))}
        code = np.array([[dense.get(s * self.cv + f, -1) for s in range(len(number))] for f in range(self.cv)])

        def blocks(batch: pa.RecordBatch):
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            dz = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
            for f in np.unique(fold):
                used = np.flatnonzero(code[f] >= 0)
                yield code[f, used], dz[fold == f][:, used]

        scored = metrics.block_scores(table, blocks, len(dense))
        return {order[g]: scored[k] for g, k in dense.items()}


def _values(batch: pa.RecordBatch, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Folds and values, NaN in gaps."""
    fold = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
    if not len(fold):
        return fold, np.zeros((0, count))
    return fold, np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(count)], axis=1)


def _expanded(batch: pa.RecordBatch, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folds, and for each row one, the shifted values (nought in gaps) and the gap marks."""
    fold, values = _values(batch, len(pivot))
    gaps = np.isnan(values)
    return fold, np.hstack([np.ones((len(fold), 1)), np.where(gaps, 0.0, values - pivot), gaps.astype(float)])
