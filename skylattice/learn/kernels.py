"""Kernel regression on landmarks: ridge and epsilon-insensitive support vectors from distributed sums.

A kernel is replaced by the map ``phi(x) = k(x, L) W`` of at most ``LANDMARKS`` rows L, the ones of least hash, with
``W W' = k(L, L)^+``: the best approximation of the kernel by functions of those rows, exact if all rows are landmarks
(``kernel_error`` measures it on other rows). Fits then need sums over ``phi`` only: a task sends one matrix of the
landmarks' size, whatever its rows, and the driver solves systems of that size.

Support vectors minimise ``|v|^2 / 2 + C sum_i w_i max(0, |y_i - v phi_i - b| - epsilon)`` by Newton steps along the central path
of a logarithmic barrier, whose slacks have a closed form in each row. The barrier shrinks tenfold whenever a step comes
near the path, until the duality gap, measured over all rows, is below ``GAP`` of the objective: the answer is within that
of the optimum, and the gap is told with it. The passes grow with the logarithm of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from skylattice.learn.features import FEATURES

LANDMARKS = 256
#: Eigenvalues of the landmarks' kernel below this share of the largest are noise.
_RANK = 1e-12
GAP = 1e-3
_STEPS, _HALVINGS = 120, 12
#: The barrier is divided by this after a step that promises less than the barrier.
_SHRINK = 10.0


@dataclass(frozen=True)
class Kernel:
    """``rbf``: exp(-gamma |x - y|^2); ``polynomial``: ((gamma x.y + coef0) / size) ** degree."""

    kind: str
    gamma: float
    degree: int = 1
    coef0: float = 0.0
    #: Divides the base of a power, so that high degrees stay finite.
    size: float = 1.0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            return np.exp(-self.gamma * np.maximum(square, 0.0))
        return ((self.gamma * (x @ y.T) + self.coef0) / self.size) ** self.degree


@dataclass(frozen=True)
class LandmarkMap:
    kernel: Kernel
    landmarks: np.ndarray
    factors: np.ndarray

    @property
    def width(self) -> int:
        return self.factors.shape[1]

    def phi(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.landmarks) @ self.factors


def _rows_of_least_hash(table: DataFrame, most: int, seed: int) -> np.ndarray:
    x = vector_to_array(FEATURES)
    picked = table.where("_weight > 0").select(x.alias("x")).distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(most)
    return np.array([r["x"] for r in picked.collect()], float)


def landmark_map(table: DataFrame, kernel: Kernel, most: int = LANDMARKS, seed: int = 0) -> LandmarkMap:
    return map_of(_rows_of_least_hash(table, most, seed), kernel)


def map_of(marks: np.ndarray, kernel: Kernel) -> LandmarkMap:
    if not len(marks):
        return LandmarkMap(kernel, np.zeros((0, 1)), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    kept = values > _RANK * values[-1]
    return LandmarkMap(kernel, marks, vectors[:, kept] / np.sqrt(values[kept]))


def kernel_error(table: DataFrame, mapped: LandmarkMap, rows: int = 256, seed: int = 1) -> float:
    """Root mean square of what the map misses of the kernel, over that of the kernel, on a sample of rows."""
    x = _rows_of_least_hash(table, rows, seed)
    whole, phi = mapped.kernel(x, x), mapped.phi(x)
    return float(np.sqrt(((whole - phi @ phi.T) ** 2).mean() / (whole**2).mean()))


def plain_rows(table: DataFrame) -> DataFrame:
    return table.where("_weight > 0").select(vector_to_array(FEATURES).alias("x"), F.col("_label").alias("y"), F.col("_weight").alias("w"))


def spread_rows(table: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain_rows`` written in as many parts as tasks run at once: passes over a small file would be one task each."""
    return stage(plain_rows(table).repartition(table.sparkSession.sparkContext.defaultParallelism))


class HeldRows:
    """Rows of one task, with their map: kept where it is small, else told block by block.

    A row that is so far from every landmark that its kernel is nought has a map of nought, of which no column is kept.
    """

    #: Rows of a block, and bytes of a map that is kept.
    BLOCK, KEPT = 8192, 128 << 20

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, mapped: LandmarkMap):
        self.x, self.y, self.w, self.mapped, self.kept = x, y, w, mapped, None
        far, kept, size = [], [], 0
        for start in range(0, len(x), self.BLOCK):
            some = slice(start, start + self.BLOCK)
            near = mapped.kernel(x[some], mapped.landmarks)
            seen = near.any(axis=1)
            kept.append((near[seen] @ mapped.factors, y[some][seen], w[some][seen]))
            far.append(np.flatnonzero(~seen) + start)
            size += kept[-1][0].nbytes
            if size > self.KEPT:
                return
        far = np.concatenate(far) if far else np.empty(0, int)
        self.kept = [p for p in kept if len(p[1])] + ([(np.empty((len(far), 0)), y[far], w[far])] if len(far) else [])

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.kept is not None:
            yield from self.kept
            return
        for start in range(0, len(self.x), self.BLOCK):
            some = slice(start, start + self.BLOCK)
            yield self.mapped.phi(self.x[some]), self.y[some], self.w[some]


def _sums(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``add(x, y, w)``, an array of ``size`` rows, over all rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = add(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sent = rows.mapInArrow(partial, "i int, row array<double>")
    found = {r["i"]: r["row"].toArray() for r in sent.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()}
    return np.array([found[i] for i in range(size)]) if found else np.zeros((size, 0))


def ridge(rows: DataFrame, mapped: LandmarkMap, alpha: float) -> np.ndarray:
    """Coefficients of ``phi`` that minimise the weighted squares and ``alpha`` times their own."""
    return ridges(rows, [mapped], [alpha])[0]


def ridges(rows: DataFrame, maps: Sequence[LandmarkMap], alphas: Sequence[float]) -> list[np.ndarray]:
    """:func:`ridge` of several maps, whose sums are taken in one pass."""
    widths = [m.width for m in maps]
    ends, most = np.cumsum(widths), max(widths)

    def add(x, y, w):
        out = np.zeros((sum(widths), most + 1))
        for mapped, width, end in zip(maps, widths, ends):
            phi = mapped.phi(x)
            out[end - width:end, :width], out[end - width:end, -1] = (phi * w[:, None]).T @ phi, (phi * w[:, None]).T @ y
        return out

    sums, answers = _sums(rows, sum(widths), add), []
    for width, end, alpha in zip(widths, ends, alphas):
        found = sums[end - width:end]
        if not found.size:
            answers.append(np.zeros(width))
            continue
        values, vectors = np.linalg.eigh(found[:, :width])
        answers.append(vectors @ ((vectors.T @ found[:, -1]) / (np.maximum(values, 0.0) + max(alpha, _RANK * max(values[-1], 1e-300)))))
    return answers


@dataclass(frozen=True)
class SupportVectors:
    coefficients: np.ndarray
    offset: float
    objective: float
    #: How far the objective may lie above its least value.
    gap: float


def _slack(t: np.ndarray, a: np.ndarray, barrier: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least ``a s - barrier (log s + log(s - t))`` over slacks s above nought and t; its slope and curvature in t, and how
    the slope changes with the barrier."""
    q = a * t
    root = np.sqrt(q * q + 4 * barrier * barrier)
    # root + q and root - q, without cancellation
    far = root + np.abs(q)
    near = 4 * barrier * barrier / far
    plus, minus = np.where(q >= 0, far, near), np.where(q >= 0, near, far)
    s, rest = (2 * barrier + plus) / (2 * a), (2 * barrier + minus) / (2 * a)
    slope = barrier / rest
    turn = (1 - barrier * (2 + 4 * barrier / root) / (2 * barrier + minus)) / rest
    return a * s - barrier * (np.log(s) + np.log(rest)), slope, slope * slope / barrier * minus / root / 2, turn


def support_vectors(rows: DataFrame | HeldRows, mapped: LandmarkMap, c: float, epsilon: float) -> SupportVectors:
    """Epsilon-insensitive regression on the map; one pass a step."""
    m, held = mapped.width, isinstance(rows, HeldRows)
    if held:
        n, mean, square = (float((rows.w * rows.y**k).sum()) for k in range(3))
    else:
        n, mean, square = (float(v or 0.0) for v in rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("y") ** 2)).first())
    if not n:
        return SupportVectors(np.zeros(m), 0.0, 0.0, 0.0)
    mean /= n
    spread = max(square / n - mean * mean, 0.0) ** 0.5
    shares = 0.5 ** np.arange(_HALVINGS)
    # A pass over held rows is cheap: halves are looked at where the whole step fails.
    first = shares[:1] if held else shares

    def pass_over(theta: np.ndarray, step: np.ndarray, barrier: float, newton: np.ndarray, before: float, shares: np.ndarray = first) -> tuple:
        """At ``theta + step``: objective with the barrier, gradient, Hessian, its change with the barrier, the objective itself.

        From the same pass, the objective with the barrier at halves of the step, and a bound from below: that of the
        dual variables at ``theta`` moved by its Newton step under the barrier before, which makes them sum to nought.
        """
        more = -(-len(shares) // (m + 6))

        def weigh(phi, y, w):
            # Without columns the map is nought, and only the offset is moved.
            used = slice(m - phi.shape[1], m + 1)
            phi, a = np.hstack([phi, np.ones((len(y), 1))]), c * w
            r, move = y - phi @ theta[used], phi @ step[used]
            up, down = _slack(r - move - epsilon, a, barrier), _slack(move - r - epsilon, a, barrier)
            up0, down0 = _slack(r - epsilon, a, before), _slack(-r - epsilon, a, before)
            dual = np.clip(up0[1] - down0[1] - (up0[2] + down0[2]) * (phi @ newton[used]), -a, a)
            out = np.zeros((m + 1, m + 6))
            bent = phi * np.sqrt(up[2] + down[2])[:, None]
            out[used, used] = bent.T @ bent
            out[used, m + 1] = phi.T @ (up[1] - down[1])
            out[used, m + 2] = phi.T @ (up[3] - down[3])
            out[used, m + 3] = phi.T @ dual
            out[0, m + 4] = a @ np.maximum(np.abs(r - move) - epsilon, 0.0)
            out[0, m + 5] = dual @ y - epsilon * np.abs(dual).sum()
            tried = [(up[0] + down[0]).sum(), *(
                (_slack(r - t * move - epsilon, a, barrier)[0] + _slack(t * move - r - epsilon, a, barrier)[0]).sum() for t in shares[1:])]
            return np.vstack([out, np.resize(np.append(tried, np.zeros(m + 6)), (more, m + 6))])

        s = sum(weigh(*part) for part in rows.parts()) if held else _sums(rows, m + 1 + more, lambda x, y, w: weigh(mapped.phi(x), y, w))
        tried, end = s[m + 1:].ravel()[:len(shares)], theta + step
        gradient, hessian, pull = -s[:m + 1, m + 1], s[:m + 1, :m + 1], s[:m, m + 3]
        gradient[:m] += end[:m]
        hessian[:m, :m] += np.eye(m)
        own = end[:m] @ end[:m] / 2
        # What the dual variables lack of summing to nought is charged at the width of the answers.
        below = s[0, m + 5] - pull @ pull / 2 - abs(s[m, m + 3]) * (abs(end[m]) + 10 * spread + epsilon)
        halves = [(theta[:m] + t * step[:m]) @ (theta[:m] + t * step[:m]) / 2 + v for t, v in zip(shares, tried)]
        return halves[0], gradient, hessian, -s[:m + 1, m + 2], own + s[0, m + 4], halves, below

    theta, barrier, still = np.append(np.zeros(m), mean), c * max(spread, epsilon, 1e-12), np.zeros(m + 1)
    now = pass_over(theta, still, barrier, still, barrier)
    best, bound = (now[4], theta), max(now[6], 0.0)
    for _ in range(_STEPS):
        if best[0] - bound <= GAP * best[0]:
            break
        value, gradient, hessian, drift = now[:4]
        found = -np.linalg.lstsq(hessian, np.stack([gradient, drift], axis=1), rcond=None)[0]
        newton, before = found[:, 0], barrier
        promised = -(gradient @ newton)
        if promised <= barrier:
            # Near the path: along it, to where the smaller barrier has its centre.
            barrier /= _SHRINK
            step = newton + found[:, 1] * (barrier - before)
            now = pass_over(theta, step, barrier, newton, before)
        else:
            step = newton
            now = pass_over(theta, step, barrier, newton, before)
            if held and now[5][0] > value - 1e-4 * promised:
                now = pass_over(theta, step, barrier, newton, before, shares)
            good = [k for k, t in enumerate(shares[:len(now[5])]) if now[5][k] <= value - 1e-4 * t * promised]
            if not good:
                break
            if good[0]:
                step = step * shares[min(good, key=lambda k: now[5][k])]
                now = pass_over(theta, step, barrier, newton, before)
        theta = theta + step
        best, bound = min(best, (now[4], theta), key=lambda b: b[0]), max(bound, now[6])
    return SupportVectors(best[1][:m], float(best[1][m]), float(best[0]), float(max(best[0] - bound, 0.0)))


def predictor(mapped: LandmarkMap, coefficients: np.ndarray, offset: float, name: str) -> Callable[[DataFrame], DataFrame]:
    def transform(df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((mapped, coefficients, offset))

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            m, b, c = sent.value
            return pd.Series(m.phi(np.stack(x.to_numpy())) @ b + c if len(x) else np.empty(0), dtype=float)

        return df.withColumn(name, guess(vector_to_array(FEATURES)))
    return transform
