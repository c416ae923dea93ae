"""Sky geometry as column expressions.

Angles are degrees in columns and arcseconds in thresholds. Neighbour search works on unit
vectors: a cube lattice over them has no poles and no 0/360 seam, and two objects closer than
a radius differ by at most that radius along each axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ARCSEC_PER_DEGREE = 3600.0


def arcsec(degrees: Column) -> Column:
    return degrees * F.lit(ARCSEC_PER_DEGREE)


def present(c: Column) -> Column:
    """True where a number is neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def located(ra: str, dec: str) -> Column:
    """True where both coordinates are present."""
    return F.expr(f"`{ra}` IS NOT NULL AND NOT isnan(`{ra}`) AND `{dec}` IS NOT NULL AND NOT isnan(`{dec}`)")


def coordinate(name: str, alias: str) -> Column:
    """A coordinate of located rows as a column without NULLs."""
    return F.expr(f"coalesce(CAST(`{name}` AS DOUBLE), 0D)").alias(alias)


def separation(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    """Great-circle separation in degrees (haversine, stable at small angles)."""
    return F.expr(
        f"degrees(2D * asin(least(1D, sqrt("
        f"pow(sin(radians(`{dec2}` - `{dec1}`) / 2D), 2D)"
        f" + cos(radians(`{dec1}`)) * cos(radians(`{dec2}`)) * pow(sin(radians(`{ra2}` - `{ra1}`) / 2D), 2D)))))"
    )


def unit_vector(ra: str, dec: str, names: Sequence[str]) -> list[Column]:
    """x, y, z of a position as columns called ``names``.

    They are declared free of NULLs, and so are the cells derived from them: otherwise Spark guards
    each join on cells by an IS NOT NULL filter over the whole expression, once per axis.
    """
    parts = (
        f"cos(radians(`{dec}`)) * cos(radians(`{ra}`))",
        f"cos(radians(`{dec}`)) * sin(radians(`{ra}`))",
        f"sin(radians(`{dec}`))",
    )
    return [F.expr(f"coalesce({p}, 0D)").alias(n) for p, n in zip(parts, names)]


def reach(radius_arcsec: float) -> float:
    """Largest axis difference of unit vectors closer than the radius, with a small margin."""
    return math.radians(radius_arcsec / ARCSEC_PER_DEGREE) * 1.001 + 1e-14


def own_cell(axes: Sequence[str], names: Sequence[str], side: float) -> list[Column]:
    """Lattice cell that holds a position; ``axes`` and ``names`` run over x, y, z."""
    return [F.expr(f"coalesce(floor(`{a}` * {1.0 / side!r}D), 0L)").alias(n) for a, n in zip(axes, names)]


def with_reached_cells(df: DataFrame, axes, names, side: float, radius: float) -> DataFrame:
    """One row per lattice cell that the ball of ``radius`` around a row touches.

    With cells of eight radii that is about two cells per row, instead of the 27 of a
    lattice as fine as the radius.
    """
    for a, n in zip(axes, names):
        low, high = (f"floor((`{a}` {sign} {radius!r}D) * {1.0 / side!r}D)" for sign in "-+")
        df = df.withColumn(n, F.expr(f"explode(sequence({low}, {high}))"))
    return df


def within(left: Sequence[str], right: Sequence[str], radius: float) -> Column:
    """True where two unit vectors, given as name triples, are within a chord of ``radius``."""
    terms = " + ".join(f"(`{a}` - `{b}`) * (`{a}` - `{b}`)" for a, b in zip(left, right))
    return F.expr(f"{terms} <= {radius * radius!r}D")
