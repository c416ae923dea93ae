"""Nearest-neighbour match of two catalogues within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skylattice.functions import sky
from skylattice.operators import crowded
from skylattice.session import staged

SEARCH_SIDE = 8.0
LEFT, RIGHT = ("_lx", "_ly", "_lz"), ("_rx", "_ry", "_rz")
CELLS = ["_cellx", "_celly", "_cellz"]


def nearest(
    left: DataFrame,
    right: DataFrame,
    radius_arcsec: float,
    left_key: Sequence[str],
    right_key: str,
    payload: Sequence[str] = (),
    left_coords: tuple[str, str] = ("RA", "DEC"),
    right_coords: tuple[str, str] = ("RA", "DEC"),
    right_separated: bool = False,
    crowd: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """For each left object its nearest right object closer than the radius.

    Returns ``left_key``, ``right_key``, ``d2d`` (degrees), ``payload`` (right columns) and ``carry``
    (left columns, which travel with the search instead of being joined on again);
    left objects without a partner are absent. Equal distances go to the smaller right key.

    ``right_separated=True`` states that the right side went through
    :func:`skylattice.operators.dedup.separated` with a tolerance not far below the radius; geometry
    then bounds the number of right objects in a search cell. Otherwise right objects at the same position are folded to the one
    with the smallest key before the join, and cells with more than ``crowd`` of them are searched
    level by level, see :mod:`skylattice.operators.crowded`; one small job looks for such cells.
    """
    left_key, payload, carry = list(left_key), list(payload), list(carry)
    seeking = seekers(left, left_key, left_coords, carry)
    offered = offers(right, right_key, payload, right_coords, fold=not right_separated)
    if right_separated:
        found = _closest(candidate_pairs(seeking, offered, sky.reach(radius_arcsec)), left_key, radius_arcsec)
    else:
        found = _with_crowds(seeking, offered, left_key, radius_arcsec, crowd)
    return found_columns(found, left_key, right_key, payload, carry)


def seekers(left: DataFrame, left_key: Sequence[str], coords: tuple[str, str], carry: Sequence[str]) -> DataFrame:
    """Located left objects with their unit vectors."""
    return left.filter(sky.located(*coords)).select(
        *left_key, F.struct(F.lit(0).alias("_"), *carry).alias("_left"),
        sky.coordinate(coords[0], "_lra"), sky.coordinate(coords[1], "_ldec"),
    ).select("*", *sky.unit_vector("_lra", "_ldec", LEFT))


def offers(
    right: DataFrame, right_key: str, payload: Sequence[str], coords: tuple[str, str], fold: bool = True
) -> DataFrame:
    """Located right objects with their unit vectors; folded, one object a position."""
    offered = right.filter(sky.located(*coords)).select(
        F.struct(F.col(right_key).alias("_key"), *payload).alias("_right"),
        sky.coordinate(coords[0], "_rra"), sky.coordinate(coords[1], "_rdec"),
    )
    if fold:
        offered = offered.groupBy("_rra", "_rdec").agg(F.min("_right").alias("_right"))
    return offered.select("*", *sky.unit_vector("_rra", "_rdec", RIGHT))


def found_columns(
    found: DataFrame, left_key: Sequence[str], right_key: str, payload: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    return found.select(
        *left_key,
        F.col("_best._right._key").alias(right_key),
        F.col("_best.d2d").alias("d2d"),
        *[F.col(f"_best._right.{p}").alias(p) for p in payload],
        *[F.col(f"_left.{c}").alias(c) for c in carry],
    )


def candidate_pairs(seeking: DataFrame, offered: DataFrame, radius: float) -> DataFrame:
    """Pairs that share a search cell; a left object is in one cell, a right one in all it reaches."""
    side = radius * SEARCH_SIDE
    here = seeking.select("*", *sky.own_cell(LEFT, CELLS, side))
    there = sky.with_reached_cells(offered, RIGHT, CELLS, side, radius)
    return here.join(there, CELLS)


def _with_crowds(
    seeking: DataFrame, offered: DataFrame, left_key: list[str], radius_arcsec: float, crowd: int | None
) -> DataFrame:
    """Plain search, plus the level-by-level search for left objects of crowded cells, if any."""
    radius = sky.reach(radius_arcsec)
    side = radius * SEARCH_SIDE
    # written once: the look for crowds and the search read the same rows
    offered = staged(offered)
    reached = sky.with_reached_cells(offered, RIGHT, CELLS, side, radius)
    full = crowded.crowded_cells(reached, CELLS, crowd)
    if full.isEmpty():
        return search_cells(seeking, reached, None, left_key, radius_arcsec, side, crowd)
    return search_cells(seeking, reached, staged(full), left_key, radius_arcsec, side, crowd)


def search_cells(
    seeking: DataFrame, reached: DataFrame, full: DataFrame | None, left_key: Sequence[str],
    radius_arcsec: float, side: float, crowd: int | None, stored: bool = False,
) -> DataFrame:
    """Closest right object by left key; ``reached`` has one row per right object and cell it reaches.

    ``full`` are the crowded cells, None if there are none. ``stored``: ``reached`` lies in buckets of cells and stays
    there, by a sort-merge join; a broadcast or hash build would move it.
    """
    def still(right: DataFrame) -> DataFrame:
        return right.hint("merge") if stored else right

    placed = seeking.select("*", *sky.own_cell(LEFT, CELLS, side))
    if full is None:
        return _closest(placed.join(still(reached), CELLS), left_key, radius_arcsec)
    # the objects of crowded cells are left out on both sides: else all of a cell's meet in one task for nothing
    quiet = placed.join(full, CELLS, "left_anti").join(still(reached.join(full, CELLS, "left_anti")), CELLS)
    near_full = reached.join(full, CELLS, "left_semi").drop(*CELLS).dropDuplicates(["_rra", "_rdec"])
    busy = crowded.surviving_pairs(
        placed.join(full, CELLS, "left_semi").drop(*CELLS), near_full, LEFT, RIGHT,
        sky.reach(radius_arcsec), side, crowd
    )
    return _closest(quiet, left_key, radius_arcsec).unionByName(_closest(busy, left_key, radius_arcsec))


def _closest(pairs: DataFrame, left_key: list[str], radius_arcsec: float) -> DataFrame:
    return (
        pairs.filter(sky.within(LEFT, RIGHT, sky.reach(radius_arcsec)))
        .withColumn("d2d", sky.separation("_lra", "_ldec", "_rra", "_rdec"))
        .filter(sky.arcsec(F.col("d2d")) < radius_arcsec)
        .groupBy(*left_key)
        .agg(F.expr("min(struct(d2d, _right)) AS _best"), F.first("_left").alias("_left"))
    )


def match_distances(
    left: DataFrame,
    right: DataFrame,
    left_key: Sequence[str],
    right_key: str,
    tolerance_arcsec: float = 0.3,
    max_radius_arcsec: float = 2.0,
    **options,
) -> DataFrame:
    """Every left row with ``ismatched``, the nearest right key and ``d2d`` in degrees.

    Beyond ``max_radius_arcsec`` key and distance are NULL.
    """
    found = nearest(left, right, max_radius_arcsec, left_key, right_key, **options)
    return left.join(found, list(left_key), "left").withColumn(
        "ismatched",
        F.coalesce(sky.arcsec(F.col("d2d")) < F.lit(tolerance_arcsec), F.lit(False)),
    )
