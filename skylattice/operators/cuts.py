"""Quality cuts and the other row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.config import SurveyConfig
from skylattice.functions.sky import arcsec, present


def _above(c: Column, low: float) -> Column:
    # Spark orders NaN above every number, so a bare ">" would keep it
    return ~F.isnan(c) & (c > F.lit(low))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def detection_cut(
    df: DataFrame, cfg: SurveyConfig, snr="SNR", fwhm="FWHM", mag="MAG", magerr="MAG_ERR"
) -> DataFrame:
    """Cut on the detection band; a survey without cut passes through."""
    if not cfg.detection_cut:
        return df
    conditions = [
        _above(F.col(snr), cfg.snr_min),
        _above(arcsec(F.col(fwhm)), cfg.fwhm_min_arcsec),
        F.col(mag) < cfg.mag_max,
        F.col(magerr) < cfg.magerr_max,
    ]
    if cfg.snr_max is not None:
        conditions.append(F.col(snr) < cfg.snr_max)
    return df.filter(_all(conditions))


def band_cut(df: DataFrame, cfg: SurveyConfig, morphology: bool = False) -> DataFrame:
    """The same thresholds on every configured band of a wide table."""
    conditions = []
    for b in cfg.bands:
        conditions += [
            _above(F.col(f"SNR_WIN_{b}"), cfg.snr_min),
            _above(arcsec(F.col(f"FWHM_WORLD_{b}")), cfg.fwhm_min_arcsec),
            F.col(f"MAGERR_AUTO_{b}") < cfg.magerr_max,
        ]
        if cfg.snr_max is not None:
            conditions.append(F.col(f"SNR_WIN_{b}") < cfg.snr_max)
    if morphology and cfg.morph_magerr_max is not None:
        conditions.append(F.col("gal_mag_err") < cfg.morph_magerr_max)
    return df.filter(_all(conditions))


def positive(df: DataFrame, column: str = "Z_SPEC") -> DataFrame:
    return df.filter(_above(F.col(column), 0.0))


def has_value(df: DataFrame, column: str = "Z_SPEC") -> DataFrame:
    return df.filter(present(F.col(column)))


def errors_below(df: DataFrame, columns: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Rows whose error columns are all below the limit; missing errors do not pass."""
    return df.filter(_all(F.col(c) < limit for c in columns))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value (NULL or NaN)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def lonely_objects(df: DataFrame, key: str, tile: str = "tile") -> DataFrame:
    """``(tile, key)`` of the objects that are the only ones of their tile; such tiles are skipped.

    Carrying the key makes the exclusion a join on single objects, so a tile that holds a large
    share of all rows does not gather in one task.
    """
    per_tile = df.groupBy(tile).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key))
    return per_tile.filter("_n = 1").select(tile, key)
