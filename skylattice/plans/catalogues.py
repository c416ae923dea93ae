"""Catalogue building: spectroscopic catalogue, tile catalogues, merged catalogues.

All tiles go through one plan; what the reference data keeps apart per tile is kept apart by
the ``tile`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.config import MATCHED_PARAMS, MORPHOLOGY_COLUMNS, UNMATCHED_PARAMS, SurveyConfig
from skylattice.operators import crossmatch, cuts, dedup, project
from skylattice.session import staged
from skylattice.sources.fits import read_fits
from skylattice.sources.tables import nan_to_null

OBJECT = ["tile", "ide"]
# output name -> source column of the detection band
DETECTION = {
    "RA": "X_WORLD", "DEC": "Y_WORLD", "SNR": "SNR_WIN", "FWHM": "FWHM_WORLD",
    "MAG": "MAG_AUTO", "MAG_ERR": "MAGERR_AUTO", "ELONGATION": "ELONGATION",
}


def spectroscopic_catalogue(spec: DataFrame, key: Sequence[str], tolerance_arcsec: float = 0.3) -> DataFrame:
    """Objects with positive redshift and no close neighbour among them."""
    usable = cuts.positive(spec)
    kept = dedup.separated(usable, key, tolerance_arcsec)
    return usable.join(kept, list(key), "left_semi")


def detection_table(bands: dict[str, DataFrame], cfg: SurveyConfig) -> DataFrame:
    """Rows of the detection band that pass the detection cut, with short detection names added."""
    table = bands[cfg.detection_band]
    return cuts.detection_cut(table.withColumns({n: F.col(s) for n, s in DETECTION.items()}), cfg)


def detected(good: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Keys of the usable objects among the rows that passed the detection cut.

    Duplicates are judged among the survivors of the same tile; tiles with a single survivor
    are skipped.
    """
    kept = dedup.separated(good, ["ide"], cfg.tolerance_arcsec, by=["tile"])
    return kept.join(cuts.lonely_objects(good, "ide"), OBJECT, "left_anti")


def usable_objects(
    bands: dict[str, DataFrame], cfg: SurveyConfig, params: Sequence[str], redshift: bool = False
) -> DataFrame:
    """Wide rows (``PARAM_BAND``) of the usable objects with ``RA, DEC, FWHM, ELONGATION``.

    Band tables, keys and morphology meet on (``tile``, ``ide``), so every table is exchanged once,
    after its cut. The bands of a tile are aligned by row, which lets the detection band alone
    decide on cut and duplicates.
    """
    good = detection_table(bands, cfg)
    carry: dict[str, dict[str, str]] = {cfg.bands[0]: {"NUMBER": "id"}}
    shown = {n: n for n in ("RA", "DEC", "FWHM", "ELONGATION")}
    if redshift:
        shown["Z"] = "Z_SPEC"
    tables = {b: bands[b] for b in cfg.bands}
    if cfg.detection_band in tables:
        tables[cfg.detection_band] = good
        carry.setdefault(cfg.detection_band, {}).update(shown)
        wide = project.assemble_bands(tables, params, carry)
    else:
        own = good.select(*OBJECT, *[F.col(s).alias(t) for s, t in shown.items()])
        wide = project.assemble_bands(tables, params, carry).join(own, OBJECT)
    return wide.join(detected(good, cfg), OBJECT, "left_semi")


def _finish(df: DataFrame, cfg: SurveyConfig, params: Sequence[str], morphology: bool) -> DataFrame:
    """Sentinels, per-band cut, helper columns, zero point."""
    magnitudes = [p for p in ("MAG_AUTO", "MAG_WIN") if p in params]
    df = project.magnitude_sentinels(df, cfg, magnitudes)
    df = cuts.band_cut(df, cfg, morphology)
    df = df.drop(*[f"{p}_{b}" for p in ("SNR_WIN", "FWHM_WORLD") for b in cfg.bands])
    return project.zero_point(df, cfg)


def band_columns(cfg: SurveyConfig, band: str, matched: bool = True, images: Sequence[str] = ()) -> list[str]:
    """Columns of a band's table that the tile workflows read."""
    wanted = [*(MATCHED_PARAMS if matched else UNMATCHED_PARAMS), *images]
    if band == cfg.bands[0]:
        wanted.append("NUMBER")
    if band == cfg.detection_band:
        wanted += [*DETECTION.values(), *(["Z"] if matched else [])]
    return list(dict.fromkeys(wanted))


def read_bands(spark: SparkSession, path: str, cfg: SurveyConfig, matched: bool = True, images: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The survey's band tables from the tile files below ``path``, each with the columns the workflows read."""
    found = {}
    for band in dict.fromkeys((cfg.detection_band, *cfg.bands)):
        found[band] = nan_to_null(read_fits(spark, path, band, ",".join(band_columns(cfg, band, matched, images))))
    return found


def matched_tiles(
    bands: dict[str, DataFrame], morphology: DataFrame, cfg: SurveyConfig, images: Sequence[str] = ()
) -> DataFrame:
    """Objects with a redshift of their own and morphology; ``images`` are cut-out columns to carry along."""
    objects = usable_objects(bands, cfg, [*MATCHED_PARAMS, *images], redshift=True)
    shapes = morphology.select("tile", *MORPHOLOGY_COLUMNS)
    objects = objects.join(shapes, ["tile", "id"]).drop("id")
    objects = _finish(cuts.has_value(objects), cfg, MATCHED_PARAMS, morphology=True)
    return project.with_object_name(cuts.positive(objects))


def unmatched_tiles(bands: dict[str, DataFrame], cfg: SurveyConfig, images: Sequence[str] = ()) -> DataFrame:
    """All usable objects of the photometric tiles; ``images`` are cut-out columns to carry along."""
    objects = usable_objects(bands, cfg, [*UNMATCHED_PARAMS, *images])
    return project.with_object_name(_finish(objects, cfg, UNMATCHED_PARAMS, morphology=False))


def spectra_for_tiles(
    bands: dict[str, DataFrame], spec: DataFrame, cfg: SurveyConfig, spec_key: str
) -> DataFrame:
    """Photometric objects that have a spectrum within the tolerance, with its redshift.

    ``spec`` is the output of :func:`spectroscopic_catalogue`.
    """
    usable = staged(usable_objects(bands, cfg, UNMATCHED_PARAMS).drop("id"))
    pairs = crossmatch.nearest(
        usable, spec, cfg.tolerance_arcsec, OBJECT, spec_key, ["Z_SPEC"], right_separated=True
    )
    matched = usable.join(pairs.select(*OBJECT, "Z_SPEC"), OBJECT)
    return project.with_object_name(_finish(matched, cfg, UNMATCHED_PARAMS, morphology=False))


def distance_table(
    bands: dict[str, DataFrame], spec: DataFrame, cfg: SurveyConfig, spec_key: str,
    max_radius_arcsec: float = 2.0,
) -> DataFrame:
    """``ismatched``, partner and distance of every usable photometric object."""
    usable = staged(usable_objects(bands, cfg, ()).select(*OBJECT, "RA", "DEC"))
    return crossmatch.match_distances(
        usable, spec, OBJECT, spec_key, cfg.tolerance_arcsec, max_radius_arcsec, right_separated=True
    )


def merge_tiles(catalogue: DataFrame, cfg: SurveyConfig, policy: str = "drop_all") -> DataFrame:
    """One catalogue from the tiles' rows, without objects that are close across tiles.

    ``drop_all`` removes an object seen in two overlapping tiles altogether, ``keep_first`` keeps
    one of its rows. Images stay in the row of their object. The tile rows are written once,
    because the search reads their positions apart from their other columns.
    """
    return dedup.drop_duplicates_on_sky(
        staged(catalogue), OBJECT, tolerance_arcsec=cfg.tolerance_arcsec, policy=policy
    )


def merge_distances(distances: DataFrame, cfg: SurveyConfig, policy: str = "drop_all") -> DataFrame:
    """Merged distance table, without positions."""
    return merge_tiles(distances, cfg, policy).drop("RA", "DEC")
