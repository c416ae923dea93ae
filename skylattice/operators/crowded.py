"""Nearest-neighbour search inside crowded cells.

A cell that holds very many right objects would pair each of its left objects with all of them.
Here the cell is split level by level into boxes, each with the bounds of its parts, down to boxes
of a few right objects. A left object first looks into its own box of the last level. If the ball
of what it finds there stays in that box, it is done. One that finds nothing follows a single path
from its cell to the last level, always into the part whose far side is nearest, for a bound. Then
all that are left meet only the boxes that the ball of their bound touches. So a left object is one
row for most of its way, and the right objects of a box arrive as one array. The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skylattice.functions import sky
from skylattice.session import staged

# right objects in a search cell from which it counts as crowded
CROWD = 512
# right objects that a box of the last level may hold
LEAF = 32
SPLIT = 4
# boxes of this level are about as narrow as positions are rounded
MAX_LEVEL = 16
# rounding of unit vectors
SLACK = 1e-14

BOX = ["_bx", "_by", "_bz"]
START = ["_sx", "_sy", "_sz"]
BOUNDS = [f"_{f}{i}" for i in range(3) for f in ("min", "max")]


def crowded_cells(offered: DataFrame, cells: Sequence[str], crowd: int | None = None) -> DataFrame:
    """Search cells with more right objects than ``crowd``; ``offered`` has one row per reached cell."""
    limit = CROWD if crowd is None else crowd
    return offered.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*cells)


def surviving_pairs(
    seeking: DataFrame, offered: DataFrame, left_axes: Sequence[str], right_axes: Sequence[str],
    radius: float, side: float, leaf: int | None = None,
) -> DataFrame:
    """Pairs that hold every left object's nearest right object within ``radius``.

    ``seeking`` are the left objects of crowded cells, ``offered`` the right objects that reach
    into those cells, one row each.
    """
    columns, kept = seeking.columns, offered.columns
    offered = staged(offered)
    depth = 0
    while depth < MAX_LEVEL and _too_full(offered, right_axes, side / SPLIT ** depth, LEAF if leaf is None else leaf):
        depth += 1
    levels = _levels(offered, right_axes, side, depth)
    last = side / SPLIT ** depth
    chord = f"sqrt({' + '.join(f'pow(r.`{b}` - `{a}`, 2D)' for a, b in zip(left_axes, right_axes))})"
    best = f"array_min(transform(_inside, r -> {chord}))"

    looked = staged(
        seeking.select("*", *sky.own_cell(left_axes, BOX, last)).join(levels[-1], BOX, "left")
        .withColumn("_d", F.expr(best))
        .withColumn("_hits", F.expr(f"filter(_inside, r -> {chord} <= _d + {SLACK!r}D)"))
        .select(*columns, "_d", "_hits")
    )
    # distance to the nearest wall of the own box
    walls = ", ".join(
        f"`{a}` - {last!r}D * floor(`{a}` * {1.0 / last!r}D), {last!r}D * (1 + floor(`{a}` * {1.0 / last!r}D)) - `{a}`"
        for a in left_axes)
    inside = F.expr(f"coalesce(_d + {2 * SLACK!r}D < least({walls}), false)")
    done = looked.filter(inside).select(*columns, F.explode("_hits").alias("_hit"))

    near = looked.filter(~inside & F.col("_d").isNotNull()).select(
        *columns, F.expr(f"least(_d, {radius!r}D) + {SLACK!r}D AS _bound"))
    near = _reached(near, left_axes, START, side, F.col("_bound"))
    lost = _reached(looked.filter(F.col("_d").isNull()).select(*columns), left_axes, START, side, F.lit(radius))
    lost = _greedy(lost, columns, levels, left_axes).select(
        *columns, F.expr(f"least({best}, {radius!r}D) + {SLACK!r}D AS _bound"), *START)
    front = _descend(near.unionByName(lost), columns, levels, left_axes)
    limit = f"least(_bound, {best} + {SLACK!r}D)"
    found = front.withColumn("_bound", F.expr(limit)).select(
        *columns, F.expr(f"explode(filter(_inside, r -> {chord} <= _bound)) AS _hit"))
    return done.unionByName(found).select(*columns, *[F.col(f"_hit.{c}").alias(c) for c in kept])


def _too_full(offered: DataFrame, axes: Sequence[str], side: float, leaf: int) -> bool:
    boxes = offered.groupBy(*sky.own_cell(axes, BOX, side)).agg(F.count(F.lit(1)).alias("_n"))
    return not boxes.filter(F.col("_n") > leaf).isEmpty()


def _levels(offered: DataFrame, axes: Sequence[str], side: float, depth: int) -> list[DataFrame]:
    """Occupied boxes by level: what is inside (boxes of the next level, in the last one objects).

    Boxes are made from those of the next level, so a box and its parts never disagree by rounding.
    """
    own = sky.own_cell(axes, BOX, side / SPLIT ** depth)
    tight = [F.expr(f"{f}(`{a}`) AS _{f}{i}") for i, a in enumerate(axes) for f in ("min", "max")]
    boxes = staged(offered.groupBy(*own).agg(F.collect_list(F.struct(*offered.columns)).alias("_inside"), *tight))
    levels = [boxes]
    for _ in range(depth):
        parents = [F.floor(F.col(b) / SPLIT).alias(b) for b in BOX]
        part = F.struct(*BOX, *BOUNDS).alias("_part")
        boxes = staged(
            boxes.select(*parents, part, *BOUNDS).groupBy(*BOX)
            .agg(F.collect_list("_part").alias("_inside"), *[F.expr(f"{b[1:4]}({b}) AS {b}") for b in BOUNDS]))
        levels.insert(0, boxes)
    return [b.select(*BOX, "_inside") for b in levels]


def _reached(df: DataFrame, axes: Sequence[str], names: Sequence[str], side: float, radius) -> DataFrame:
    """One row per cell that the ball around a row touches; its radius may differ from row to row."""
    for a, n in zip(axes, names):
        low, high = (F.floor(x * F.lit(1.0 / side)) for x in (F.col(a) - radius, F.col(a) + radius))
        df = df.withColumn(n, F.explode(F.sequence(low, high)))
    return df


def _near(axes: Sequence[str]) -> str:
    terms = (f"pow(greatest(p._min{i} - `{a}`, `{a}` - p._max{i}, 0D), 2D)" for i, a in enumerate(axes))
    return f"sqrt({' + '.join(terms)})"


def _far(axes: Sequence[str]) -> str:
    terms = (f"pow(greatest(abs(`{a}` - p._min{i}), abs(`{a}` - p._max{i})), 2D)" for i, a in enumerate(axes))
    return f"sqrt({' + '.join(terms)})"


def _greedy(front: DataFrame, columns: Sequence[str], levels: Sequence[DataFrame], axes: Sequence[str]) -> DataFrame:
    """Each row with the objects of the one box of the last level that its path ends in."""
    front = front.select("*", *[F.col(s).alias(b) for s, b in zip(START, BOX)])
    to = ", ".join(f"p.{b} AS {b}" for b in BOX)
    for boxes in levels[:-1]:
        front = front.join(boxes, BOX).withColumn(
            "_to", F.expr(f"array_min(transform(_inside, p -> struct({_far(axes)} AS _far, {to})))")
        ).select(*columns, *START, *[F.col(f"_to.{b}").alias(b) for b in BOX])
    return front.join(levels[-1], BOX)


def _descend(front: DataFrame, columns: Sequence[str], levels: Sequence[DataFrame], axes: Sequence[str]) -> DataFrame:
    """Rows with the objects of every box of the last level that may hold one within their bound."""
    front = front.withColumnsRenamed(dict(zip(START, BOX)))
    for boxes in levels[:-1]:
        front = front.join(boxes, BOX).withColumn(
            "_bound", F.expr(f"least(_bound, array_min(transform(_inside, p -> {_far(axes)})) + {SLACK!r}D)")
        ).select(*columns, "_bound", F.expr(f"explode(filter(_inside, p -> {_near(axes)} <= _bound)) AS _part")
        ).select(*columns, "_bound", *[F.col(f"_part.{b}").alias(b) for b in BOX])
    return front.join(levels[-1], BOX)
