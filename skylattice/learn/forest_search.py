"""Scores of many forests at once, from the trees that they share.

Trees are drawn by hashing (see :mod:`skylattice.learn.trees`), so the first trees of a forest are the smaller forest, and
a tree cut at a depth or at a least size of a node is the tree grown with that limit. Forests that differ only in the number
of trees, the depth and the least rows to split thus come from one set of trees: of the 720 points of the forest
grid, from 12 sets. Each task grows a block of trees of one set, leads the test rows through each of them once for all limits
that are asked for, and sends sums of answers; the trees themselves stay where they were grown.

This is for tables whose bins, packed, take ``SHARED_BYTES`` at most (rows are counted first): they are sent to
all tasks. ``scores`` gives None for larger ones, whose forests are fitted one by one by distributed sums.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from skylattice.learn import regressors, trees
from skylattice.operators.metrics import MAD_FACTOR, OUTLIER_LIMIT, Scores
from skylattice.session import staging

#: Trees that a task grows in turn.
BLOCK = 25
#: Bytes of the packed bins of a table that is sent to all tasks, at most: 460000 rows of six features.
SHARED_BYTES = 16 << 20


def _arrays(table: DataFrame, ends: Sequence[np.ndarray], inputs: int) -> tuple[np.ndarray, ...]:
    with staging(table.sparkSession) as stage:
        got = trees.binned(table, ends, stage).orderBy("id").toArrow().combine_chunks()
    batches = got.to_batches()
    if not batches:
        return np.empty(0, np.int64), np.empty((0, inputs), np.uint16), np.empty(0), np.empty(0)
    ids, x, y, w = (np.concatenate(c) for c in zip(*(trees._arrays(b, inputs) for b in batches)))
    return ids, x, y, w


def _led(nodes: Sequence[np.ndarray], x: np.ndarray, cuts: Mapping[int, set[int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``depth, least rows to split`` and the answers of a tree under that limit, of ``cuts`` by depth; one walk serves all."""
    feature, cut, left, right, value, rows, _ = nodes
    flat, inputs = x.ravel(), x.shape[1]
    leasts = sorted(set().union(*cuts.values()))
    # Where a row stops under the smallest limit it stops under all.
    answer = {s: np.full(len(x), value[0]) for s in leasts}
    going, here = np.arange(len(x)), np.zeros(len(x), np.int64)
    level, depths = 0, sorted(cuts)
    for depth in depths:
        while level < depth and len(going):
            inner = np.flatnonzero((feature.take(here) >= 0) & (rows.take(here) >= leasts[0]))
            going, here = going.take(inner), here.take(inner)
            below = np.where(flat.take(going * inputs + feature.take(here)) <= cut.take(here), left.take(here), right.take(here))
            found = value.take(below)
            answer[leasts[0]][going] = found
            for s in leasts[1:]:
                on = rows.take(here) >= s
                answer[s][going[on]] = found[on]
            here, level = below, level + 1
        for s in cuts[depth]:
            yield depth, s, answer[s]


def scores(points: Sequence[dict], train: DataFrame, test: DataFrame, features: Sequence[str], target: str, weight: str | None) -> list[Scores] | None:
    """Scores of the forest of each point, or None if a table is too large for this way."""
    spark, inputs = train.sparkSession, len(features)
    if max(train.count(), test.count()) * (24 + 2 * inputs) > SHARED_BYTES:
        return None
    model = regressors.regressor("RF")
    points = [{**model.params, **p} for p in points]
    growths = [regressors.forest_growth(p, inputs) for p in points]
    sets: dict[tuple, list[int]] = {}
    for k, (p, g) in enumerate(zip(points, growths)):
        sets.setdefault((p.get("maxBins", regressors.MAX_BINS), g.least_leaf, g.node_features, g.bootstrap, g.absolute, g.seed), []).append(k)
    table, rows = (regressors.fitting_table(t, features, target, weight if t is train else None) for t in (train, test))
    data = {}
    for bins in {key[0] for key in sets}:
        ends = trees.bin_ends(table, inputs, bins)
        data[bins] = (_arrays(table, ends, inputs), _arrays(rows, ends, inputs)[1:3])
    # Bounded by SHARED_BYTES for each number of bins.
    sent = spark.sparkContext.broadcast(data)
    jobs, limits, counts = [], [], []
    for s, (key, members) in enumerate(sets.items()):
        deepest = max(growths[k].depth for k in members)
        least = min(growths[k].least_split for k in members)
        limits.append((key[0], trees.Growth(deepest, None, least, key[1], node_features=key[2], bootstrap=key[3], absolute=key[4], seed=key[5])))
        # For each limit, the numbers of trees that are asked for.
        asked: dict[tuple[int, int], set[int]] = {}
        for k in members:
            asked.setdefault((growths[k].depth, growths[k].least_split), set()).add(points[k]["numTrees"])
        counts.append({c: sorted(n) for c, n in asked.items()})
        most = max(points[k]["numTrees"] for k in members)
        jobs += [(s, t, min(most, t + BLOCK)) for t in range(0, most, BLOCK)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, first, last in (jobs[k] for k in batch.column(0).to_pylist()):
                bins, growth = limits[s]
                (ids, x, y, w), (xt, _) = sent.value[bins]
                # By limit and the least number of trees asked for that takes in the tree.
                total: dict[tuple[int, int, int], np.ndarray] = {}
                for t in range(first, last):
                    cuts: dict[int, set[int]] = {}
                    for (depth, least), numbers in counts[s].items():
                        if t < numbers[-1]:
                            cuts.setdefault(depth, set()).add(least)
                    h = w * trees.drawn(ids, growth, t)
                    nodes = trees.grown_here(x, h * y, h, growth, t)[:7]
                    for depth, least, found in _led(nodes, xt, cuts):
                        numbers = counts[s][depth, least]
                        key = depth, least, numbers[bisect_right(numbers, t)]
                        if key in total:
                            total[key] += found
                        else:
                            total[key] = found.copy()
                n, keys = len(total), list(zip(*total)) or [()] * 3
                yield pa.RecordBatch.from_arrays([
                    pa.array([s] * n, pa.int32()), *(pa.array(k, pa.int64()) for k in keys),
                    pa.array(list(total.values()), pa.list_(pa.float64()))], ["s", "depth", "least", "trees", "sums"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, depth, least, numbers, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                y = sent.value[limits[s][0]][1][1]
                parts = sums.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(y))
                total = np.zeros(len(y))
                for b in np.argsort(numbers):
                    total += parts[b]
                    out.append((s, depth, least, numbers[b], *_scores(y, total / numbers[b])))
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["s", "depth", "least", "trees", "sigma", "eta", "bias", "n"])

    # One block a task: sets differ in what their trees cost.
    grown = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(grow, "s int, depth long, least long, trees long, sums array<double>")
    summed = grown.groupBy("s", "depth", "least", "trees").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    # A limit has as many rows as its grid has numbers of trees.
    lists = summed.withColumn("sums", vector_to_array("sums")).groupBy("s", "depth", "least").agg(
        F.collect_list(F.struct("trees", "sums")).alias("p")).select("s", "depth", "least", F.col("p.trees").alias("trees"), F.col("p.sums").alias("sums"))
    found = {(r["s"], r["depth"], r["least"], r["trees"]): Scores(r["sigma"], r["eta"], r["bias"], r["n"]) for r in lists.mapInArrow(
        judge, "s int, depth long, least long, trees long, sigma double, eta double, bias double, n long").collect()}
    number = {k: s for s, members in enumerate(sets.values()) for k in members}
    return [found[number[k], growths[k].depth, growths[k].least_split, p["numTrees"]] for k, p in enumerate(points)]


def _scores(y: np.ndarray, guess: np.ndarray) -> tuple[float, float, float, int]:
    """Robust scatter, outlier rate, mean error and rows, as :mod:`skylattice.operators.metrics` defines them."""
    usable = (y != -1.0) & np.isfinite(guess)
    dz = (y[usable] - guess[usable]) / (1.0 + y[usable])
    if not len(dz):
        raise ValueError("no predictions for a fold")
    return float(MAD_FACTOR * np.median(np.abs(dz - np.median(dz)))), float((np.abs(dz) > OUTLIER_LIMIT).mean()), float(dz.mean()), len(dz)
