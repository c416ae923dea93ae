"""Histogram trees grown by grouped statistics: forests and boosting, level by level or by best leaf.

Features are cut into bins by exact quantiles (or at every value, if there are few). What decides a split are sums by
(node, feature, bin): every task adds up its rows, the sums meet in a grouped aggregation, and of two siblings only the
one with fewer rows is summed, the other is what is left of their parent. A node whose rows are few enough (``LOCAL_ROWS``) is
finished by one task, which gets the rows of that node only. No task of a forest and no driver ever holds more rows, and the driver
holds the sums of the open nodes of a group of trees, bounded by ``HISTOGRAM_BYTES``. Boosting keeps its rows in tasks that run
at once, ``HELD_BYTES`` each at most, and goes by passes where that cannot be.

All criteria but the absolute one are second order: with sums G of gradients and H of Hessians, a split gains
``GL^2 / (HL + ridge) + GR^2 / (HR + ridge) - G^2 / (H + ridge)`` and a leaf answers ``G / (H + ridge)``. The squared error
of a weighted forest is the case of H a sum of weights and G one of weighted targets. The absolute criterion keeps, for each
(node, feature, bin), the counts and sums of ``TARGET_BINS`` parts of the target, takes the median's part of either side and
answers with exact medians of the leaves.

What is random is drawn by hashing: rows of a tree (Poisson counts for a bootstrap) from the number of the row and of
the tree, features of a node from its path. So a lost task gives the same rows again, the first k trees of a forest are
the forest of k trees, and a tree cut at a depth or a least size of a node is the tree grown with that limit.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from skylattice.learn.features import FEATURES
from skylattice.operators import order_stats
from skylattice.session import remove, shared_folder

#: Rows that one task may finish a node with, and bytes of sums that may be open at once.
LOCAL_ROWS = 50_000
HISTOGRAM_BYTES = 256 << 20
TARGET_BINS = 64
NO_LIMIT = 1 << 30
#: Rows of a block that boosting packs, and bytes of blocks that a worker is handed at once.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 16 << 20
#: Splits up to which rows go through a tree split by split.
SMALL_TREE = 64
#: A gain below this share of the parent's own term is rounding.
_NOISE = 1e-12
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


@dataclass(frozen=True)
class Growth:
    """Limits of a tree. ``leaves`` asks for growth by best leaf, else it goes level by level."""

    depth: int = NO_LIMIT
    leaves: int | None = None
    least_split: int = 2
    least_leaf: int = 1
    least_hessian: float = 0.0
    ridge: float = 0.0
    least_gain: float = 0.0
    #: Share of the features that each node and each tree may use.
    node_features: float = 1.0
    tree_features: float = 1.0
    bootstrap: bool = False
    #: Share of the rows that a tree draws, and how many trees in turn share a draw.
    rows: float = 1.0
    redraw: int = 1
    absolute: bool = False
    seed: int = 0


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code(*parts: int) -> int:
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            x = _mix(np.array([x + np.uint64(p & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)]))[0]
    return int(x)


def drawn(ids: np.ndarray, growth: Growth, tree: int) -> np.ndarray:
    """How often each row takes part in a tree."""
    if not growth.bootstrap and growth.rows >= 1.0:
        return np.ones(len(ids))
    with np.errstate(over="ignore"):
        u = (_mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_code(growth.seed, tree // growth.redraw, 1))) >> np.uint64(11)) / float(1 << 53)
    if growth.bootstrap:
        return np.searchsorted(_POISSON, u, "right").astype(float)
    return (u < growth.rows).astype(float)


def _allowed(paths: np.ndarray, growth: Growth, tree: int, inputs: int) -> np.ndarray:
    """Features that each node may split by, as a mask of nodes by features."""
    keep = np.ones((len(paths), inputs), bool)
    numbers = np.arange(inputs, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if growth.tree_features < 1.0:
            turn = _mix(numbers * np.uint64(0xD1B54A32D192ED03) + np.uint64(_code(growth.seed, tree, 2)))
            keep &= np.argsort(np.argsort(turn))[None, :] < max(1, round(growth.tree_features * inputs))
        if growth.node_features < 1.0:
            turn = _mix(paths[:, None] + numbers[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(_code(growth.seed, tree, 3)))
            turn = np.where(keep, turn >> np.uint64(1), np.uint64(2**64 - 1))
            keep &= np.argsort(np.argsort(turn, axis=1), axis=1) < max(1, int(growth.node_features * inputs + 1e-9))
    return keep


def _below(paths: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(paths * np.uint64(2) + np.uint64(side + 1))


class Tree:
    """Nodes in arrays; every node keeps its value, so a tree can be cut at any depth or size."""

    FIELDS = ("feature", "cut", "left", "right", "value", "rows", "depth")

    def __init__(self):
        self.feature, self.cut, self.left, self.right = [], [], [], []
        self.value, self.rows, self.depth, self.path = [], [], [], []

    def add(self, value: float, rows: float, depth: int, path: int) -> int:
        for field, v in zip(("feature", "cut", "left", "right"), (-1, 0, -1, -1)):
            getattr(self, field).append(v)
        self.value.append(value), self.rows.append(rows), self.depth.append(depth), self.path.append(path)
        return len(self.value) - 1

    def split(self, node: int, feature: int, cut: int, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, right

    def graft(self, node: int, other: "Tree") -> None:
        """Put a tree in the place of a leaf."""
        shift = len(self.value) - 1
        place = lambda k: -1 if k < 0 else node if k == 0 else k + shift
        for k in range(len(other.value)):
            if k:
                self.add(other.value[k], other.rows[k], other.depth[k], other.path[k])
            at = place(k)
            self.feature[at], self.cut[at] = other.feature[k], other.cut[k]
            self.left[at], self.right[at] = place(other.left[k]), place(other.right[k])
        self.value[node], self.rows[node] = other.value[0], other.rows[0]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(getattr(self, f), float if f in ("value", "rows") else np.int64) for f in self.FIELDS)


def walk(nodes: tuple[np.ndarray, ...], x: np.ndarray, depth: int = NO_LIMIT, least_split: int = 0) -> np.ndarray:
    """Node of each row of bins, in the tree cut at a depth and a least size of a node."""
    feature, cut, left, right, _, rows, level = nodes
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero((feature >= 0) & (level < depth) & (rows >= least_split))
    if len(inner) <= SMALL_TREE:
        # Split by split over all rows, parents first: a row is led on without being gathered.
        for k in inner:
            at = np.where(at == k, np.where(x[:, feature[k]] <= cut[k], left[k], right[k]), at)
        return at
    going = np.arange(len(x))
    while len(going):
        here = at[going]
        inner = (feature[here] >= 0) & (level[here] < depth) & (rows[here] >= least_split)
        going, here = going[inner], here[inner]
        at[going] = np.where(x[going, feature[here]] <= cut[here], left[here], right[here])
    return at


def _score(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return np.divide(g * g, h + ridge, out=np.zeros_like(g), where=h + ridge > 0)


def median(y: np.ndarray, w: np.ndarray) -> float:
    """Middle of weighted values; between two of them where the weights below are exactly half."""
    order = np.argsort(y, kind="stable")
    upto, half = np.cumsum(w[order]), w.sum() / 2
    k = int(np.searchsorted(upto, half * (1 - 1e-12)))
    return float((y[order[k]] + y[order[k + 1]]) / 2) if abs(upto[k] - half) <= 1e-12 * half and k + 1 < len(y) else float(y[order[k]])


def _absolute_costs(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of distances from the median's part, for rows of weights and sums by parts of the target in ascending order."""
    upto = weight.cumsum(axis=1)
    at = (upto < upto[:, -1:] / 2 * (1 - 1e-12)).sum(axis=1)[:, None]
    middle = np.take_along_axis(total, at, 1) / np.maximum(np.take_along_axis(weight, at, 1), 1e-300)
    sign = np.sign(np.arange(weight.shape[1])[None, :] - at)
    return (sign * (total - middle * weight)).sum(axis=1)


def _parted(order: np.ndarray, side: np.ndarray, to: Sequence[np.ndarray]) -> np.ndarray:
    """``order`` with each node's rows parted into left and right ones, otherwise as it was; ``to`` gives the places of either side."""
    sides, out = side.take(order), np.empty(sum(map(len, to)), np.int64)
    for k in (0, 1):
        out[to[k]] = order.take(np.flatnonzero(sides == k))
    return out


def grow_here(x: np.ndarray, g: np.ndarray, h: np.ndarray, growth: Growth, tree: int = 0, depth: int = 0, path: int = 1) -> Tree:
    """The tree of one node's rows of bins; see :func:`grown_here`."""
    *fields, paths = grown_here(x, g, h, growth, tree, depth, path)
    out = Tree()
    for name, values in zip((*Tree.FIELDS, "path"), (*fields, paths)):
        setattr(out, name, values.tolist())
    return out


def grown_here(x: np.ndarray, g: np.ndarray, h: np.ndarray, growth: Growth, tree: int = 0, depth: int = 0, path: int = 1) -> tuple[np.ndarray, ...]:
    """The tree of one node's rows of bins as arrays (``Tree.FIELDS`` and paths), level by level; rows and nodes of a level
    are handled together.

    The rows are sorted once by each feature; a level only parts these orders by the children. Gains are told
    where the bin changes.
    """
    here, inputs = np.flatnonzero(h > 0), x.shape[1]
    if not len(here):
        return tuple(np.array([v], k) for v, k in zip((-1, 0, -1, -1, 0.0, 0, depth, path), (*[np.int64] * 4, float, float, np.int64, np.uint64)))
    value = (lambda r: median(g[r] / h[r], h[r])) if growth.absolute else None
    root = value(here) if value else float(g[here].sum() / (h[here].sum() + growth.ridge))
    columns = [np.ascontiguousarray(x[:, f]) for f in range(inputs)]
    # 16-bit numbers are sorted in linear time.
    orders = [here[np.argsort(c[here].astype(np.uint16) if c.max() < 1 << 16 else c[here], kind="stable")] for c in columns]
    place, plain = np.empty(len(h), np.int64), bool((h[here] == 1.0).all())
    # Of each level: values, rows, depths, paths; of its parent level: which nodes are divided, by what.
    levels, splits, total = [(np.array([root]), np.array([len(here)]), depth, np.array([path], np.uint64))], [], 1
    rows, seg, paths = here, np.array([0]), np.array([path], np.uint64)
    while len(seg) and depth < growth.depth:
        count = np.diff([*seg, len(rows)])
        keep = _allowed(paths, growth, tree, inputs) & (count >= max(growth.least_split, 2 * growth.least_leaf))[:, None]
        if not keep.any():
            break
        loc = np.repeat(np.arange(len(seg)), count)
        inside = loc[1:] == loc[:-1]
        gt, ht = np.add.reduceat(g[rows], seg), np.add.reduceat(h[rows], seg)
        best = np.full(len(seg), -np.inf)
        parent = _score(gt, ht, growth.ridge)
        if growth.absolute:
            place[rows] = np.arange(len(rows))
            parts = _target_parts(g[rows] / h[rows], loc, seg, count)
            parent = -_absolute_costs(*_by_part(loc, parts, h[rows], g[rows], len(seg)))
        feature, cut = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
        for f in range(inputs):
            if not keep[:, f].any():
                continue
            r = orders[f]
            bins = columns[f].take(r)
            ends = np.flatnonzero((bins[1:] != bins[:-1]) & inside)
            node = loc[ends]
            left_count = ends + 1 - seg[node]
            ok = keep[node, f] & (left_count >= growth.least_leaf) & (count[node] - left_count >= growth.least_leaf)
            ends, node = ends[ok], node[ok]
            if growth.absolute:
                gain = _absolute_gains(ends, place[r], loc, seg, count, parts, h[rows], g[rows])
            else:
                upto = np.append(0.0, np.cumsum(g.take(r)))
                gl = upto[ends + 1] - upto[seg][node]
                if plain:
                    hl = left_count[ok].astype(float)
                else:
                    upto = np.append(0.0, np.cumsum(h.take(r)))
                    hl = upto[ends + 1] - upto[seg][node]
                gr, hr = gt[node] - gl, ht[node] - hl
                ok = (hl >= growth.least_hessian) & (hr >= growth.least_hessian) & (hl > 0) & (hr > 0)
                if not ok.all():
                    ends, node, gl, hl, gr, hr = (v[ok] for v in (ends, node, gl, hl, gr, hr))
                gain = _score(gl, hl, growth.ridge) + _score(gr, hr, growth.ridge)
            if not len(ends):
                continue
            turns = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            top = np.maximum.reduceat(gain, turns)
            spots = np.flatnonzero(gain == np.repeat(top, np.diff([*turns, len(node)])))
            spots = spots[np.append(True, node[spots][1:] != node[spots][:-1])]
            nodes, top = node[spots], gain[spots]
            better = top > best[nodes] + _NOISE * np.abs(best[nodes], where=np.isfinite(best[nodes]), out=np.zeros(len(nodes)))
            nodes, spots = nodes[better], spots[better]
            best[nodes], feature[nodes], cut[nodes] = top[better], f, bins[ends[spots]]
        with np.errstate(invalid="ignore"):
            divided = np.isfinite(best) & (best - parent > np.maximum(growth.least_gain, _NOISE * np.abs(parent) + 1e-300))
        splits.append((divided, feature, cut))
        children = 2 * int(divided.sum())
        if not children:
            break
        # Rows of divided nodes, by child: left children and right children of the nodes in turn.
        mine = divided[loc]
        rows, loc = rows[mine], loc[mine]
        right_side = x[rows, feature[loc]] > cut[loc]
        side = np.full(len(h), 2, np.uint8)
        side[rows] = right_side
        sizes = np.bincount(np.cumsum(divided)[loc] * 2 - 2 + right_side, minlength=children)
        is_right = np.repeat(np.arange(children) % 2 == 1, sizes)
        to = (np.flatnonzero(~is_right), np.flatnonzero(is_right))
        rows, *orders = (_parted(o, side, to) for o in (rows, *orders))
        depth += 1
        seg = np.cumsum(sizes) - sizes
        if value:
            values = np.array([value(rows[a:a + n]) for a, n in zip(seg, sizes)])
        else:
            values = np.add.reduceat(g[rows], seg) / (np.add.reduceat(h[rows], seg) + growth.ridge)
        parents = paths[divided]
        paths = np.stack([_below(parents, 0), _below(parents, 1)], axis=1).ravel()
        levels.append((values, sizes, depth, paths))
        total += children
    feature, cut, left, right = np.full(total, -1), np.zeros(total, np.int64), np.full(total, -1), np.full(total, -1)
    first = 0
    for (divided, by, at), (values, *_) in zip(splits, levels):
        nodes = first + np.flatnonzero(divided)
        first += len(values)
        feature[nodes], cut[nodes] = by[divided], at[divided]
        left[nodes] = first + 2 * np.arange(len(nodes))
        right[nodes] = left[nodes] + 1
    values, sizes, paths = (np.concatenate([level[k] for level in levels]) for k in (0, 1, 3))
    return feature, cut, left, right, values, sizes.astype(float), np.repeat([level[2] for level in levels], [len(level[0]) for level in levels]), paths


def _target_parts(y: np.ndarray, loc: np.ndarray, seg: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Part of the target's range in its node for each row, by rank: exact for up to TARGET_BINS rows."""
    order = np.lexsort((y, loc))
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y)) - np.repeat(seg, count)
    return np.where(count[loc] <= TARGET_BINS, rank, rank * TARGET_BINS // np.maximum(count[loc], 1))


def _by_part(loc, parts, h, g, nodes):
    weight = np.bincount(loc * TARGET_BINS + parts, h, nodes * TARGET_BINS).reshape(nodes, TARGET_BINS)
    return weight, np.bincount(loc * TARGET_BINS + parts, g, nodes * TARGET_BINS).reshape(nodes, TARGET_BINS)


def _absolute_gains(spots, o, loc, seg, count, parts, h, g) -> np.ndarray:
    """Minus the cost of both sides of each split, node by node."""
    found = np.empty(len(spots))
    at = 0
    while at < len(spots):
        node = loc[spots[at]]
        upto = int(np.searchsorted(loc[spots], node, "right"))
        inside = o[seg[node]:seg[node] + count[node]]
        ends = spots[at:upto] - seg[node]
        block = np.searchsorted(ends, np.arange(count[node]))  # the first split that has a row on its left
        place = block * TARGET_BINS + parts[inside]
        size = (len(ends) + 1) * TARGET_BINS
        w, t = (np.bincount(place, v[inside], size).reshape(-1, TARGET_BINS) for v in (h, g))
        wl, tl = w.cumsum(axis=0)[:-1], t.cumsum(axis=0)[:-1]
        found[at:upto] = -_absolute_costs(wl, tl) - _absolute_costs(w.sum(axis=0) - wl, t.sum(axis=0) - tl)
        at = upto
    return found


# --- bins ----------------------------------------------------------------------------------


def bin_ends(table: DataFrame, inputs: int, most: int, weighted: bool = False) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: midpoints of its values if they are few, else exact quantiles.

    ``weighted`` takes quantiles of the weights (of the Hessians, for a squared error).
    """
    x = vector_to_array(FEATURES)
    long = table.select(F.posexplode(x).alias("g", "x"), F.col("_weight").alias("w"))
    kinds = {r["g"]: r for r in long.groupBy("g").agg(F.count_distinct("x").alias("kinds"), F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    few = [g for g, r in kinds.items() if r["kinds"] <= most]
    ends: list[np.ndarray] = [np.empty(0)] * inputs
    values: dict[int, list[float]] = {g: [] for g in few}
    if few:
        for r in long.where(F.col("g").isin(few)).select("g", "x").distinct().collect():
            values[r["g"]].append(r["x"])
    many = {g: r for g, r in kinds.items() if g not in values}
    shares = np.arange(1, most) / most
    if many and weighted:
        found = order_stats.grouped_order_statistics(long, "g", "x", {g: list(shares * r["w"]) for g, r in many.items()}, weight="w")
    elif many:
        found = order_stats.grouped_order_statistics(long, "g", "x", {g: sorted(set((shares * r["n"]).astype(int).tolist())) for g, r in many.items()})
    for g in kinds:
        if g in values:
            v = np.sort(np.array(values[g]))
            ends[g] = (v[1:] + v[:-1]) / 2
        else:
            ends[g] = np.unique(found[g])
    return ends


def to_bins(x: np.ndarray, ends: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(ends)], axis=1).astype(np.int32) if len(x) else np.zeros((0, len(ends)), np.int32)


def binned(table: DataFrame, ends: Sequence[np.ndarray], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, x, y, w``: bins of each row as 16-bit numbers, under a number that is written down."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_bins(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(ends)), ends).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(3)], ["id", "x", "y", "w"])

    spark = table.sparkSession
    rows = table.select(vector_to_array(FEATURES).alias("x"), F.col("_label").alias("y"), F.col("_weight").alias("w"))
    spread = rows.repartition(spark.sparkContext.defaultParallelism)
    return stage(spread.select(F.monotonically_increasing_id().alias("id"), "x", "y", "w").mapInArrow(run, "id long, x binary, y double, w double"))


def _arrays(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, ...]:
    """The columns of a batch; bins as they lie in it, end to end, without an object for each row."""
    bins, x = batch.column(1), np.empty((0, inputs), np.uint16)
    if len(bins):
        wide = pa.types.is_large_binary(bins.type)
        start = np.frombuffer(bins.buffers()[1], np.int64 if wide else np.int32)[bins.offset]
        x = np.frombuffer(bins.buffers()[2], np.uint16, len(bins) * inputs, start).reshape(-1, inputs)
    return (batch.column(0).to_numpy(zero_copy_only=False), x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)))


def _blocked(rows: DataFrame, base: float, inputs: int) -> DataFrame:
    """``rows, margin``: runs of rows packed column after column, with one answer for all: many passes read them without a step for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def block() -> pa.RecordBatch:
            ids, x, y, w = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([_pack(ids, w, y, x)], pa.binary()), pa.array([np.full(len(ids), base).tobytes()], pa.binary())], ["rows", "margin"])

        for batch in batches:
            if batch.num_rows:
                held.append(_arrays(batch, inputs))
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    return rows.select("id", "x", "y", "w").mapInArrow(run, "rows binary, margin binary")


def _parts(batch: pa.RecordBatch, inputs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``id, x, y, w`` of a batch of rows, and ``margin`` of each of its blocks of rows."""
    if batch.schema.names[0] != "rows":
        yield _arrays(batch, inputs)
        return
    for block, margin in zip(batch.column(0), batch.column(1)):
        ids, w, y, x = _unpack(block.as_buffer(), inputs)
        yield ids, x, y, w, np.frombuffer(margin.as_buffer())


# --- sums over all rows ---------------------------------------------------------------------


def _histograms(rows: DataFrame, trees: dict[int, tuple], slots: dict[int, dict[int, int]], growth: Growth, inputs: int, bins: int,
                answer: Callable | None = None, target_ends: np.ndarray | None = None) -> np.ndarray:
    """Sums by slot, feature, bin: rows, Hessians and gradients (or weights and sums by part of the target).

    ``slots`` numbers the wanted nodes of each tree; ``answer`` gives what earlier trees say of rows of bins.
    """
    count = sum(len(s) for s in slots.values())
    kinds = 3 if target_ends is None else 1 + 2 * TARGET_BINS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, inputs, bins, kinds))
        for ids, x, y, w, *margin in (part for batch in batches for part in _parts(batch, inputs)):
            for t, wanted in slots.items():
                number = np.full(len(trees[t][0]), -1)
                number[list(wanted)] = list(wanted.values())
                slot = number[walk(trees[t], x)]
                h = w * drawn(ids, growth, t)
                some = np.flatnonzero((slot >= 0) & (h > 0))
                if not len(some):
                    continue
                s, h, v, mine = slot[some], h[some], y[some], x[some]
                if margin:
                    # Asked for the rows that are summed only: of two siblings, the fewer.
                    v = v - margin[0][some] - (answer(mine) if answer else 0.0)
                base, last = s.min(), s.max() + 1
                size = int(last - base) * bins
                first, sums, plain = (s - base) * bins, h * v, bool((h == 1.0).all())
                for f in range(inputs):
                    place = first + mine[:, f]
                    into = total[base:last, f]
                    rows_in = np.bincount(place, minlength=size).reshape(-1, bins)
                    into[:, :, 0] += rows_in
                    if target_ends is None:
                        into[:, :, 1] += rows_in if plain else np.bincount(place, h, size).reshape(-1, bins)
                        into[:, :, 2] += np.bincount(place, sums, size).reshape(-1, bins)
                    else:
                        part = place * TARGET_BINS + np.searchsorted(target_ends, v, "left")
                        for k, weights in enumerate((h, sums)):
                            got = np.bincount(part, weights, size * TARGET_BINS).reshape(-1, bins, TARGET_BINS)
                            into[:, :, 1 + k * TARGET_BINS:1 + (k + 1) * TARGET_BINS] += got
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), pa.array(list(total.reshape(count, -1)), pa.list_(pa.float64()))], ["slot", "sums"])

    sent = rows.mapInArrow(partial, "slot int, sums array<double>")
    found = np.zeros((count, inputs * bins * kinds))
    for r in sent.groupBy("slot").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect():
        found[r["slot"]] = r["sums"].toArray()
    return found.reshape(count, inputs, bins, kinds)


@dataclass
class _Open:
    """A node that may be split, with its sums and its best split."""

    node: int
    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    #: Features that the sums are of, where they are not of all.
    features: np.ndarray | None = None


def _best_split(tree: Tree, t: int, open_: _Open, growth: Growth) -> None:
    node, sums = open_.node, open_.sums
    rows, depth = sums[0, :, 0].sum(), tree.depth[node]
    if depth >= growth.depth or rows < max(growth.least_split, 2 * growth.least_leaf):
        return
    if open_.features is None:
        keep = _allowed(np.array([tree.path[node]], np.uint64), growth, t, len(sums))[0]
    else:
        keep = np.ones(len(sums), bool)
    upto = sums.cumsum(axis=1)
    left, right = upto, upto[:, -1:] - upto
    ok = keep[:, None] & (left[..., 0] >= max(1, growth.least_leaf)) & (right[..., 0] >= max(1, growth.least_leaf))
    if growth.absolute:
        flat = lambda s: -_absolute_costs(s[..., 1:1 + TARGET_BINS].reshape(-1, TARGET_BINS), s[..., 1 + TARGET_BINS:].reshape(-1, TARGET_BINS)).reshape(s.shape[:-1])
        gain, parent = flat(left) + flat(right), flat(upto[:, -1:])[:, 0].max()
    else:
        hl, hr = left[..., 1], right[..., 1]
        ok &= (hl >= growth.least_hessian) & (hr >= growth.least_hessian) & (hl > 0) & (hr > 0)
        gain = _score(left[..., 2], np.where(ok, hl, 1.0), growth.ridge) + _score(right[..., 2], np.where(ok, hr, 1.0), growth.ridge)
        parent = _score(upto[:1, -1, 2], upto[:1, -1, 1], growth.ridge)[0]
    gain = np.where(ok, gain, -np.inf)
    top = gain.max()
    if np.isfinite(top) and top - parent > max(growth.least_gain, _NOISE * abs(parent) + 1e-300):
        spots = np.argwhere(gain >= top - _NOISE * abs(top))
        open_.gain, (open_.feature, open_.cut) = float(top - parent), map(int, spots[0])
        if open_.features is not None:
            open_.feature = int(open_.features[open_.feature])


def _value(sums: np.ndarray, growth: Growth) -> float:
    if growth.absolute:
        return 0.0
    h = sums[0, :, 1].sum() + growth.ridge
    return float(sums[0, :, 2].sum() / h) if h > 0 else 0.0


def _grow_by_sums(rows: DataFrame, numbers: Sequence[int], growth: Growth, inputs: int, bins: int, local_rows: int,
                  answer: Callable | None = None, target_ends: np.ndarray | None = None) -> tuple[dict[int, Tree], list[tuple[int, int]]]:
    """Trees with all splits of nodes above ``local_rows``, and the nodes (tree, node) left to be finished."""
    kinds = 3 if target_ends is None else 1 + 2 * TARGET_BINS
    at_once = max(1, HISTOGRAM_BYTES // (8 * inputs * bins * kinds))

    def sums_of(wanted: list[tuple[int, int]]) -> list[np.ndarray]:
        found = []
        for start in range(0, len(wanted), at_once):
            slots: dict[int, dict[int, int]] = {}
            for k, (t, node) in enumerate(wanted[start:start + at_once]):
                slots.setdefault(t, {})[node] = k
            found += list(_histograms(rows, {t: trees[t].arrays() for t in slots}, slots, growth, inputs, bins, answer, target_ends))
        return found

    trees = {t: Tree() for t in numbers}
    for t in numbers:
        trees[t].add(0.0, 0, 0, 1)
    level: dict[int, list[_Open]] = {}
    for t, sums in zip(numbers, sums_of([(t, 0) for t in numbers])):
        trees[t].value[0], trees[t].rows[0] = _value(sums, growth), sums[0, :, 0].sum()
        level[t] = [_Open(0, sums)]
    left_over: list[tuple[int, int]] = []
    leaves = {t: 1 for t in numbers}
    while any(level.values()):
        chosen: list[tuple[int, _Open]] = []
        for t, opened in level.items():
            for o in [o for o in opened if o.feature < 0 and o.gain == 0.0]:
                if growth.leaves is None and trees[t].rows[o.node] <= local_rows:
                    left_over.append((t, o.node))
                    opened.remove(o)
                    continue
                _best_split(trees[t], t, o, growth)
                if o.feature < 0:
                    opened.remove(o)
            ready = sorted(opened, key=lambda o: (-o.gain, o.node))
            if growth.leaves is not None:
                ready = ready[:1] if leaves[t] < growth.leaves else []
                if not ready:
                    opened.clear()
            for o in ready:
                opened.remove(o)
                chosen.append((t, o))
        asked, kept = [], []
        for t, o in chosen:
            tree, upto = trees[t], o.sums[o.feature, :o.cut + 1, 0].sum()
            paths = np.array([tree.path[o.node]], np.uint64)
            kids = [tree.add(0.0, n, tree.depth[o.node] + 1, int(_below(paths, s)[0])) for s, n in ((0, upto), (1, tree.rows[o.node] - upto))]
            tree.split(o.node, o.feature, o.cut, *kids)
            leaves[t] += 1
            # Sums of the children tell their values; whether they are needed further is seen here.
            done = tree.depth[kids[0]] >= growth.depth or (growth.leaves is not None and leaves[t] >= growth.leaves)
            if done and not growth.absolute:
                side = o.sums[o.feature].cumsum(axis=0)[o.cut]
                for kid, s in zip(kids, (side, o.sums[o.feature].sum(axis=0) - side)):
                    tree.value[kid] = float(s[2] / (s[1] + growth.ridge))
                continue
            small = 0 if tree.rows[kids[0]] <= tree.rows[kids[1]] else 1
            asked.append((t, kids[small]))
            kept.append((t, o, kids, small))
        for (t, o, kids, small), sums in zip(kept, sums_of(asked) if asked else []):
            both = {small: sums, 1 - small: o.sums - sums}
            for s in (0, 1):
                trees[t].value[kids[s]] = _value(both[s], growth)
                level[t].append(_Open(kids[s], both[s]))
        if growth.leaves is not None:
            for t in numbers:
                if leaves[t] >= growth.leaves:
                    level[t] = []
    return trees, left_over


def _pack(ids: np.ndarray, h: np.ndarray, y: np.ndarray, x: np.ndarray) -> bytes:
    """Rows of a node, column after column, bins as 16-bit numbers."""
    return ids.astype(np.int64).tobytes() + h.astype(float).tobytes() + y.astype(float).tobytes() + x.astype(np.uint16).tobytes()


def _unpack(data: bytes | pa.Buffer, inputs: int) -> tuple[np.ndarray, ...]:
    n = len(data) // (24 + 2 * inputs)
    return (np.frombuffer(data, np.int64, n), np.frombuffer(data, float, n, 8 * n), np.frombuffer(data, float, n, 16 * n),
            np.frombuffer(data, np.uint16, n * inputs, 24 * n).reshape(n, inputs))


def _finish(rows: DataFrame, trees: dict[int, Tree], nodes: list[tuple[int, int]], growth: Growth, inputs: int) -> None:
    """Grow the rest below nodes of few rows: their rows meet in one task each."""
    if not nodes:
        return
    numbered = {t: t_nodes for t in trees if (t_nodes := {n: k for k, (u, n) in enumerate(nodes) if u == t})}
    packed = {t: trees[t].arrays() for t in numbered}
    places = [(t, n, trees[t].depth[n], trees[t].path[n]) for t, n in nodes]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, y, w = _arrays(batch, inputs)
            keys, blobs = [], []
            for t, wanted in numbered.items():
                number = np.full(len(packed[t][0]), -1)
                number[list(wanted)] = list(wanted.values())
                slot, h = number[walk(packed[t], x)], w * drawn(ids, growth, t)
                # sorted once: a look for every node's rows would cost rows times nodes
                mine = np.flatnonzero((slot >= 0) & (h > 0))
                mine = mine[np.argsort(slot[mine], kind="stable")]
                for some in np.split(mine, np.flatnonzero(np.diff(slot[mine])) + 1) if len(mine) else ():
                    keys.append(int(slot[some[0]]))
                    blobs.append(_pack(ids[some], h[some], y[some], x[some]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["slot", "rows"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> tuple[list, list]:
            if now is None:
                return [], []
            ids, h, y, x = (np.concatenate(c) for c in zip(*(_unpack(b, inputs) for b in held)))
            o = np.argsort(ids, kind="stable")  # one order of the rows, whatever task came first
            t, _, depth, path = places[now]
            tree = grow_here(x[o].astype(np.int64), (h * y)[o], h[o], growth, t, depth, path)
            return [now], [_dump(tree)]

        for batch in batches:
            keys, dumps = [], []
            for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot != now:
                    k, d = done()
                    keys += k
                    dumps += d
                    now, held = slot, []
                held.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(dumps, pa.binary())], ["slot", "tree"])
        k, d = done()
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["slot", "tree"])

    parts = max(len(nodes) // 4, rows.sparkSession.sparkContext.defaultParallelism)
    sent = rows.mapInArrow(deal, "slot int, rows binary").repartition(min(parts, len(nodes)), "slot").sortWithinPartitions("slot")
    for r in sent.mapInArrow(grow, "slot int, tree binary").collect():
        t, node = nodes[r["slot"]]
        trees[t].graft(node, _load(bytes(r["tree"])))


def _dump(tree: Tree) -> bytes:
    return np.array([*(getattr(tree, f) for f in Tree.FIELDS), [p >> 32 for p in tree.path], [p & 0xFFFFFFFF for p in tree.path]], float).tobytes()


def _load(data: bytes) -> Tree:
    m = np.frombuffer(data).reshape(len(Tree.FIELDS) + 2, -1)
    tree = Tree()
    for f, row in zip(Tree.FIELDS, m):
        setattr(tree, f, row.tolist() if f in ("value", "rows") else row.astype(int).tolist())
    tree.path = [(int(a) << 32) | int(b) for a, b in zip(m[-2], m[-1])]
    return tree


# --- models ---------------------------------------------------------------------------------


@dataclass
class Ensemble:
    """Trees over the bins of a table: ``base + sum of factor * tree``."""

    ends: list[np.ndarray]
    nodes: list[tuple[np.ndarray, ...]]
    base: float
    factor: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for n in self.nodes:
            total += n[4][walk(n, x)]
        return self.base + self.factor * total

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            model = sent.value
            return pd.Series(model.raw(to_bins(np.stack(x.to_numpy()), model.ends)) if len(x) else np.empty(0), dtype=float)

        return df.withColumn(name, guess(vector_to_array(FEATURES)))


def forest(table: DataFrame, trees: int, growth: Growth, bins: int, inputs: int, stage: Callable[[DataFrame], DataFrame],
           local_rows: int = LOCAL_ROWS) -> Ensemble:
    """Mean of trees that are grown side by side, a group of them at a time."""
    ends = bin_ends(table, inputs, bins)
    rows = binned(table, ends, stage)
    n, = rows.agg(F.count("*")).first()
    width, kinds = max(len(e) for e in ends) + 1, 1 + 2 * TARGET_BINS if growth.absolute else 3
    target_ends = None
    if growth.absolute:
        shares = sorted({n * k // TARGET_BINS for k in range(1, TARGET_BINS)} - {0}) if n else []
        found = order_stats.grouped_order_statistics(rows.select(F.lit(0).alias("g"), "y"), "g", "y", {0: shares})[0] if shares else []
        target_ends = np.unique(found)
    most_open = max(1, 2 * n // max(1, local_rows))
    group = max(1, HISTOGRAM_BYTES // (8 * inputs * width * kinds * most_open))
    nodes = []
    for start in range(0, trees, group):
        numbers = range(start, min(trees, start + group))
        if n <= local_rows:
            grown, rest = {t: Tree() for t in numbers}, [(t, 0) for t in numbers]
            for t in numbers:
                grown[t].add(0.0, n, 0, 1)
        else:
            grown, rest = _grow_by_sums(rows, numbers, growth, inputs, width, local_rows, target_ends=target_ends)
        _finish(rows, grown, rest, growth, inputs)
        if growth.absolute:
            _set_medians(rows, grown, set(rest), growth, inputs)
        nodes += [grown[t].arrays() for t in numbers]
    return Ensemble(ends, nodes, 0.0, 1.0 / max(1, len(nodes)))


def _set_medians(rows: DataFrame, trees: dict[int, Tree], finished: set[tuple[int, int]], growth: Growth, inputs: int) -> None:
    """Exact medians for leaves that no single task has seen; weights and repeated draws count by order statistics of weight."""
    number: dict[tuple[int, int], int] = {}
    for t, tree in trees.items():
        below = set()
        for node in range(len(tree.value)):
            if (t, node) in finished or node in below:
                below |= {tree.left[node], tree.right[node]}
            elif tree.feature[node] < 0:
                number[t, node] = len(number)
    if not number:
        return
    packed = {t: tree.arrays() for t, tree in trees.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, y, w = _arrays(batch, inputs)
            for t, nodes in packed.items():
                g = np.array([number.get((t, n), -1) for n in range(len(nodes[0]))])[walk(nodes, x)]
                h = w * drawn(ids, growth, t)
                some = (g >= 0) & (h > 0)
                yield pa.RecordBatch.from_arrays([pa.array(g[some], pa.int32()), pa.array(y[some]), pa.array(h[some])], ["g", "y", "h"])

    long = rows.mapInArrow(run, "g int, y double, h double")
    total = {r["g"]: r["h"] for r in long.groupBy("g").agg(F.sum("h").alias("h")).collect()}
    found = order_stats.grouped_order_statistics(long, "g", "y", {g: [h / 2 * (1 - 1e-12), h / 2 * (1 + 1e-12)] for g, h in total.items()}, weight="h")
    for (t, node), g in number.items():
        if g in found:
            trees[t].value[node] = sum(found[g]) / 2


#: Rounds of boosting after which what all trees say of a row is written down anew.
REFRESH = 10


def boosted(table: DataFrame, rounds: int, rate: float, growth: Growth, bins: int, inputs: int, stage: Callable[[DataFrame], DataFrame],
            base: float | None = None, weighted_bins: bool = False) -> Ensemble:
    """Trees fitted to what the ones before leave; ``base`` is the first answer, the weighted mean by default.

    Tasks that run at once keep their rows for all rounds and add up their sums among themselves (:func:`_held_rounds`). Where
    that cannot be, each round costs passes (:func:`_passed_rounds`).
    """
    ends = bin_ends(table, inputs, bins, weighted_bins)
    rows = binned(table, ends, stage)
    n, w, wy, least, most = rows.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("y")), F.min("w"), F.max("w")).first()
    base = float((wy / w if w else 0.0) if base is None else base)
    width, tasks, nodes = max(len(e) for e in ends) + 1, _held_tasks(rows, n, inputs), None
    if tasks:
        weighted = growth.bootstrap or not least == most == 1.0
        nodes = _held_rounds(rows, tasks, rounds, rate, growth, inputs, width, base, weighted)
    if nodes is None:
        nodes = _passed_rounds(rows, rounds, rate, growth, inputs, width, base, stage)
    return Ensemble(ends, nodes, base, rate)


def _passed_rounds(rows: DataFrame, rounds: int, rate: float, growth: Growth, inputs: int, width: int, base: float,
                   stage: Callable[[DataFrame], DataFrame]) -> list[tuple[np.ndarray, ...]]:
    """Each round costs a pass for the root and one for every level or leaf. Every ``REFRESH`` rounds the answers are
    written down, so a row is led through few trees a pass. Passes read blocks of packed rows: handing a task
    one row after the other takes longer than its sums.
    """
    # Blocks are large rows: a batch of them is bounded by its bytes.
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    rows = stage(_blocked(rows, base, inputs))
    nodes, recent = [], []

    def answer(x: np.ndarray) -> np.ndarray:
        return rate * sum((n[4][walk(n, x)] for n in recent), np.zeros(len(x)))

    for k in range(rounds):
        grown, _ = _grow_by_sums(rows, [k], growth, inputs, width, 0, answer)
        recent.append(grown[k].arrays())
        nodes.append(recent[-1])
        if len(grown[k].value) == 1 and abs(grown[k].value[0]) < 1e-300:
            break  # nothing is left to fit
        if len(recent) == REFRESH and k + 1 < rounds:
            rows = stage(_refreshed(rows, answer, inputs))
            recent = []
    return nodes


def _refreshed(rows: DataFrame, answer: Callable, inputs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(margin + answer(x)).tobytes() for _, x, _, _, margin in _parts(batch, inputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rows", "margin"])

    return rows.mapInArrow(run, "rows binary, margin binary")


# --- boosting by tasks that keep their rows ---------------------------------------------------

#: Rows that are worth a task of their own, bytes of rows that a task may keep, and rows that are added up at once.
HELD_ROWS, HELD_BYTES, _PIECE = 200_000, 1 << 29, 1 << 15
#: Seconds in which tasks that run at once have to see each other's first files.
PATIENCE = 30.0


def _held_tasks(rows: DataFrame, n: int, inputs: int) -> int:
    """Tasks to keep the rows in, or none: too many rows for those that run at once, or tasks that cannot be told to run at once."""
    context = rows.sparkSession.sparkContext
    tasks = max(1, min(context.defaultParallelism, -(-n // HELD_ROWS)))
    if n * (2 * inputs + 48) > tasks * HELD_BYTES:
        return 0
    return 0 if tasks > 1 and context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true" else tasks


class _Held:
    """The rows that a task keeps: bins by feature, and what the trees so far leave of the target."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, base: float, bins: int, weighted: bool):
        self.ids, self.bins, self.weighted = ids, bins, weighted
        self.columns = [np.ascontiguousarray(x[:, f], np.uint8 if bins <= 256 else np.uint16) for f in range(x.shape[1])]
        self.left, self.w, self.h, self.draw = y - base, w, w, (-1, None, None)

    def drawn(self, growth: Growth, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that take part in a tree, and the others."""
        if self.draw[0] != tree // growth.redraw:
            self.h = self.w * drawn(self.ids, growth, tree)
            self.draw = (tree // growth.redraw, np.flatnonzero(self.h > 0), np.flatnonzero(self.h <= 0))
        return self.draw[1:]

    def sums(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Counts, gradients and, of weighted rows, Hessians by feature and bin."""
        out = np.zeros((len(features), 2 + self.weighted, self.bins))
        for start in range(0, len(rows), _PIECE):
            some = rows[start:start + _PIECE]
            g = self.left.take(some)
            if self.weighted:
                h = self.h.take(some)
                g = g * h
            for k, f in enumerate(features):
                place = self.columns[f].take(some).astype(np.intp)
                out[k, 0] += np.bincount(place, minlength=self.bins)
                out[k, 1] += np.bincount(place, g, self.bins)
                if self.weighted:
                    out[k, 2] += np.bincount(place, h, self.bins)
        return out

    def parted(self, rows: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        left = self.columns[feature].take(rows) <= cut
        return rows[left], rows[~left]


def _grow_held(held: _Held, t: int, growth: Growth, inputs: int, rate: float, together: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Tree:
    """The tree of all tasks' rows; ``together`` adds up what they found, so all grow the same one. The rows are left with what it leaves.

    Sums are taken of the features that a node may use. Where siblings use the same, the one of more rows gets what is left
    of its parent.
    """
    tree, alone = Tree(), growth.node_features < 1.0
    tree.add(0.0, 0, 0, 1)
    rows = {0: held.drawn(growth, t)}

    def usable(node: int) -> np.ndarray:
        return np.flatnonzero(_allowed(np.array([tree.path[node]], np.uint64), growth, t, inputs)[0])

    def sums_of(wanted: list[int], features: list[np.ndarray]) -> list[np.ndarray]:
        found = together([held.sums(rows[n][0], f) for n, f in zip(wanted, features)])
        return [s[:, [0, 2, 1] if held.weighted else [0, 0, 1]].transpose(0, 2, 1) for s in found]

    shared, leaves = usable(0), 1
    opened = [_Open(0, sums, features=shared) for sums in sums_of([0], [shared])]
    tree.value[0], tree.rows[0] = _value(opened[0].sums, growth), opened[0].sums[0, :, 0].sum()
    fresh = opened
    while True:
        for o in fresh:
            _best_split(tree, t, o, growth)
        opened = sorted((o for o in opened if o.feature >= 0), key=lambda o: (-o.gain, o.node))
        if growth.leaves is not None:
            opened, ready = opened[1:], opened[:1] if leaves < growth.leaves else []
        else:
            opened, ready = [], opened
        if not ready:
            break
        asked, kept = [], []
        for o in ready:
            mine = o.sums[np.searchsorted(o.features, o.feature)]
            side = mine[:o.cut + 1].sum(axis=0)
            both = (side, mine.sum(axis=0) - side)
            kids = [tree.add(float(s[2] / (s[1] + growth.ridge)), s[0], tree.depth[o.node] + 1, int(_below(np.array([tree.path[o.node]], np.uint64), k)[0])) for k, s in enumerate(both)]
            tree.split(o.node, o.feature, o.cut, *kids)
            taking, others = rows.pop(o.node)
            rows.update(zip(kids, zip(held.parted(taking, o.feature, o.cut), held.parted(others, o.feature, o.cut))))
            leaves += 1
            if tree.depth[kids[0]] >= growth.depth or (growth.leaves is not None and leaves >= growth.leaves):
                continue
            if alone:
                asked += kids
            else:
                small = 0 if both[0][0] <= both[1][0] else 1
                asked.append(kids[small])
            kept.append((o, kids))
        features = [usable(n) if alone else shared for n in asked]
        found = dict(zip(asked, zip(sums_of(asked, features), features))) if asked else {}
        fresh = []
        for o, kids in kept:
            for kid, other in (kids, kids[::-1]):
                sums, used = found[kid] if kid in found else (o.sums - found[other][0], shared)
                fresh.append(_Open(kid, sums, features=used))
        opened += fresh
    for node, parts in rows.items():
        for part in parts:
            held.left[part] -= rate * tree.value[node]
    return tree


class _Exchange:
    """Tasks that run at once hear each other's sums through files of a folder that all of them see.

    A round of messages starts when its task's own is written; files of the round before the last are read by all and go.
    """

    def __init__(self, folder: str, me: int, tasks: int):
        self.folder, self.me, self.tasks, self.round = folder, me, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def path(self, turn: int, task: int) -> str:
        return f"{self.folder}/{turn}-{task}"

    def heard(self, message: bytes, patience: float = math.inf) -> list[bytes] | None:
        """The messages of all tasks in their order, or None if some do not come in time."""
        with open(f"{self.path(self.round, self.me)}.new", "wb") as f:
            f.write(message)
        os.replace(f.name, self.path(self.round, self.me))
        found, until = [], time.monotonic() + patience
        for task in range(self.tasks):
            while not os.path.exists(self.path(self.round, task)):
                if time.monotonic() > until:
                    return None
                time.sleep(0.0005)
            with open(self.path(self.round, task), "rb") as f:
                found.append(f.read())
        if self.round:
            os.remove(self.path(self.round - 1, self.me))
        self.round += 1
        return found


def _held_rounds(rows: DataFrame, tasks: int, rounds: int, rate: float, growth: Growth, inputs: int, bins: int, base: float,
                 weighted: bool) -> list[tuple[np.ndarray, ...]] | None:
    """All rounds in one stage: each task keeps its rows and hears the others' sums, so rows are read once.

    None if the tasks do not see each other's files in the shared folder.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.empty(0, np.int64), np.empty((0, inputs), np.uint16), np.empty(0), np.empty(0))]
        parts += [_arrays(batch, inputs) for batch in batches]
        held = _Held(*(np.concatenate(c) for c in zip(*parts)), base, bins, weighted)
        parts.clear()
        me, exchange = 0, None
        if tasks > 1:
            context = BarrierTaskContext.get()
            me = context.partitionId()
            # A folder for each attempt of the stage. Spark's own messages take a second each, so the sums go by files.
            attempt = context.allGather(uuid.uuid4().hex)[0]
            exchange = _Exchange(f"{folder.removeprefix('file:')}/{attempt}", me, tasks)
            if exchange.heard(b"", PATIENCE) is None:
                return

        def together(found: list[np.ndarray]) -> list[np.ndarray]:
            if exchange is None:
                return found
            heard, at, out = exchange.heard(b"".join(a.tobytes() for a in found)), 0, []
            for a in found:
                out.append(sum(np.frombuffer(m, float, a.size, at).reshape(a.shape) for m in heard))
                at += a.nbytes
            return out

        dumps = []
        for k in range(rounds):
            tree = _grow_held(held, k, growth, inputs, rate, together)
            dumps.append(_dump(tree))
            if len(tree.value) == 1 and abs(tree.value[0]) < 1e-300:
                break  # nothing is left to fit
        if me == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(dumps)), pa.int32()), pa.array(dumps, pa.binary())], ["k", "tree"])

    plain = rows.select("id", "x", "y", "w")
    spread = plain.repartition(tasks, "id") if tasks > 1 else plain.coalesce(1)
    try:
        found = spread.mapInArrow(run, "k int, tree binary", barrier=tasks > 1).collect()
    finally:
        if tasks > 1:
            remove(spark, folder)
    return [_load(bytes(r["tree"])).arrays() for r in sorted(found, key=lambda r: r["k"])] if found else None
