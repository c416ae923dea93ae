"""Removal of objects that lie closer than a tolerance to another object.

The work stays linear however crowded a spot is. Objects at the same position are counted and
folded to one row by a partial aggregation. A fine cube lattice has cells whose diagonal is below the
tolerance, so all members of a cell with two or more objects are duplicates without any pair being
formed. Only the one object that may stay of each fine cell is compared with its surroundings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.functions import sky

POLICIES = ("drop_all", "keep_first")
# side of a fine cell in tolerances: diagonal sqrt(3) * 0.5 = 0.87 of the tolerance
FINE_SIDE = 0.5
# side of a search cell in tolerances
SEARCH_SIDE = 8.0


def separated(
    df: DataFrame,
    key: Sequence[str],
    tolerance_arcsec: float = 0.3,
    by: Sequence[str] = (),
    coords: tuple[str, str] = ("RA", "DEC"),
    policy: str = "drop_all",
) -> DataFrame:
    """Keys (``by`` + ``key``) of the objects that stay.

    ``key`` identifies an object within its ``by`` group. ``drop_all`` keeps objects whose nearest
    other object is at or beyond the tolerance, so both members of a close pair go. ``keep_first``
    keeps objects without a close object of a smaller key. Objects without a position are left out.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    by, key = list(by), list(key)
    identity: Column = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    xyz, centre, cells = ("_x", "_y", "_z"), ("_cx", "_cy", "_cz"), ["_cellx", "_celly", "_cellz"]
    # copies of one position fold into one row before the exchange, whatever their share
    positions = (
        df.filter(sky.located(*coords))
        .select(*by, identity.alias("_id"), sky.coordinate(coords[0], "_ra"), sky.coordinate(coords[1], "_dec"))
        .groupBy(*by, "_ra", "_dec")
        .agg(F.expr("count(1) AS _n"), F.expr("min(_id) AS _id"))
        .select("*", *sky.unit_vector("_ra", "_dec", xyz))
    )

    radius = sky.reach(tolerance_arcsec)
    cubes = positions.groupBy(*by, *sky.own_cell(xyz, ("_fx", "_fy", "_fz"), radius * FINE_SIDE)).agg(
        F.expr("sum(_n) AS _n"), F.expr("min(_id) AS _cid"),
        F.expr("min_by(_ra, _id) AS _cra"), F.expr("min_by(_dec, _id) AS _cdec"),
    )
    if policy == "drop_all":
        cubes = cubes.filter("_n = 1")
    candidates = cubes.select(*by, "_cid", sky.coordinate("_cra", "_cra"), sky.coordinate("_cdec", "_cdec"))

    side = radius * SEARCH_SIDE
    around = sky.with_reached_cells(
        candidates.select("*", *sky.unit_vector("_cra", "_cdec", centre)), centre, cells, side, radius
    )
    # the condition always holds; it keeps the columns of the branch above, so both reuse one exchange
    placed = positions.filter("_n > 0").select(*by, "_id", "_ra", "_dec", *xyz, *sky.own_cell(xyz, cells, side))
    other = F.expr("_id <> _cid" if policy == "drop_all" else "_id < _cid")
    close = sky.arcsec(sky.separation("_cra", "_cdec", "_ra", "_dec")) < tolerance_arcsec
    crowded = (
        around.join(placed, by + cells)
        .filter(other & sky.within(centre, xyz, radius) & close)
        .select(*by, "_cid")
        .distinct()
    )
    # as above: the same columns as the search, so both reuse one exchange
    alone = candidates.filter("_cra > -1000D AND _cdec > -1000D")
    kept = alone.select(*by, "_cid").join(crowded, by + ["_cid"], "left_anti")
    if len(key) == 1:
        return kept.withColumnRenamed("_cid", key[0])
    return kept.select(*by, *[F.col("_cid").getField(k).alias(k) for k in key])


def flag_duplicates(
    df: DataFrame,
    key: Sequence[str],
    tolerance_arcsec: float = 0.3,
    by: Sequence[str] = (),
    coords: tuple[str, str] = ("RA", "DEC"),
    policy: str = "drop_all",
) -> DataFrame:
    """The input with a boolean ``isdup``; rows without a position are never duplicates."""
    kept = separated(df, key, tolerance_arcsec, by, coords, policy).withColumn("_kept", F.lit(True))
    return (
        df.join(kept, list(by) + list(key), "left")
        .withColumn("isdup", sky.located(*coords) & F.col("_kept").isNull())
        .drop("_kept")
    )


def drop_duplicates_on_sky(df: DataFrame, key: Sequence[str], **options) -> DataFrame:
    """Rows whose object stays, see :func:`separated`."""
    return flag_duplicates(df, key, **options).filter(~F.col("isdup")).drop("isdup")
