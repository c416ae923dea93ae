"""Training tables from three independent surveys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skylattice.operators import crossmatch, cuts, project
from skylattice.operators.sky_index import SkyIndex
from skylattice.session import staged

TOLERANCE = 0.3


@dataclass(frozen=True)
class ThreeSurveys:
    matched: DataFrame
    unmatched: DataFrame
    r_comparison: DataFrame


def u_survey(df: DataFrame) -> DataFrame:
    """u survey with sentinels as NULL and a usable error; columns ``u_id, RA, DEC, MAG_u, MAG_r``."""
    values = [c for c in df.columns if c != "u_id"]
    clean = project.external_sentinels(df, values)
    return cuts.errors_below(clean, ["MAGERR_u"]).select(
        "u_id", F.col("ALPHA_J2000").alias("RA"), F.col("DELTA_J2000").alias("DEC"), "MAG_u", "MAG_r"
    )


#: What the chain takes from the r catalogues; an index of one offers these.
R_COLUMNS = ("MAG_AUTO_R", *project.MORPHOLOGY, "gal_g1", "gal_g2", "Z_SPEC")
DEEP_COLUMNS = ("g_stk_aper", "i_stk_aper", "z_stk_aper")


def deep_survey(df: DataFrame) -> DataFrame:
    """Deep survey with usable errors in g, i and z."""
    bands = ("g", "i", "z")
    good = cuts.errors_below(df, [f"{b}_stk_aper_err" for b in bands])
    return good.select("deep_id", F.col("ra").alias("RA"), F.col("dec").alias("DEC"), *[f"{b}_stk_aper" for b in bands])


def u_with_deep(u: DataFrame, deep: DataFrame | SkyIndex, tolerance: float = TOLERANCE) -> DataFrame:
    """u-survey objects with their nearest deep-survey partner."""
    return _partners(u, deep, tolerance, "deep_id", DEEP_COLUMNS, False).drop("d2d")


def _partners(
    left: DataFrame, right: DataFrame | SkyIndex, tolerance: float, key: str, payload: Sequence[str], separated: bool
) -> DataFrame:
    """Nearest partners in a table or in a stored index of it."""
    if isinstance(right, SkyIndex):
        if right.key != key:
            raise ValueError(f"the index is keyed by {right.key}, not {key}")
        return right.nearest(left, tolerance, ["u_id"], payload, carry=_others(left))
    return crossmatch.nearest(left, right, tolerance, ["u_id"], key, payload, right_separated=separated, carry=_others(left))


def _others(left: DataFrame) -> list[str]:
    return [c for c in left.columns if c != "u_id"]


def with_redshift(
    base: DataFrame, r_matched: DataFrame | SkyIndex, r_key: str, morphology: bool = True,
    tolerance: float = TOLERANCE, keep: Sequence[str] = ("u_id",), separated: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Training table of the chain and the comparison of the two r magnitudes.

    ``r_matched`` is a merged catalogue, which holds no two objects closer than the tolerance unless
    ``separated=False``.
    """
    shapes = list(project.MORPHOLOGY) + ["gal_g1", "gal_g2"] if morphology else []
    offered = r_matched.payload if isinstance(r_matched, SkyIndex) else r_matched.columns
    shapes = [c for c in shapes if c in offered]
    found = _partners(base, r_matched, tolerance, r_key, ["MAG_AUTO_R", *shapes, "Z_SPEC"], separated)
    medium = project.shear(found) if {"gal_g1", "gal_g2"} <= set(shapes) else found
    names = {**project.THREE_SURVEY_MAGNITUDES, **(project.MORPHOLOGY if morphology else {}), **project.TARGET}
    return project.short_names(medium, names, keep), medium.select(*keep, "MAG_r", "MAG_AUTO_R")


def without_redshift(
    base: DataFrame, r_unmatched: DataFrame | SkyIndex, r_key: str,
    tolerance: float = TOLERANCE, keep: Sequence[str] = ("u_id",), separated: bool = True,
) -> DataFrame:
    """Population table of the chain: magnitudes of all objects found in the three surveys."""
    found = _partners(base, r_unmatched, tolerance, r_key, ["MAG_AUTO_R"], separated)
    return project.short_names(found, project.THREE_SURVEY_MAGNITUDES, keep)


def three_surveys(
    u: DataFrame, deep: DataFrame | SkyIndex, r_matched: DataFrame | SkyIndex, r_unmatched: DataFrame | SkyIndex, r_key: str,
    morphology: bool = True, tolerance: float = TOLERANCE, **options,
) -> ThreeSurveys:
    """u survey -> deep survey -> r catalogue, with and without redshifts.

    The first match feeds both chains and is written once. Catalogues may be given as stored indexes
    (:mod:`skylattice.operators.sky_index`), which later chains search without exchanging them; an index of
    the deep survey holds :func:`deep_survey`'s rows.
    """
    if not isinstance(deep, SkyIndex):
        deep = deep_survey(deep)
    base = staged(u_with_deep(u_survey(u), deep, tolerance))
    matched, comparison = with_redshift(base, r_matched, r_key, morphology, tolerance, **options)
    unmatched = without_redshift(base, r_unmatched, r_key, tolerance, **options)
    return ThreeSurveys(matched, unmatched, comparison)
