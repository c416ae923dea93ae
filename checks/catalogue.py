"""Catalogue queries: cuts, duplicates, cross-matches, tiles, surveys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import BANDS, ctes, read, view
from skylattice.config import SurveyConfig
from skylattice.operators import crossmatch, cuts, dedup, histogram, order_stats, pixels, project, sky_index, statistics
from skylattice.plans import catalogues, surveys
from skylattice.session import shared_folder, staged
from skylattice.sources import tables

CAPPED = SurveyConfig.capped_range(bands=tuple(BANDS))
OPEN = SurveyConfig.open_range(bands=tuple(BANDS))

# --- SQL building blocks ------------------------------------------------------------------

def _apart(a: str, b: str) -> str:
    return (
        f"degrees(2e0*asin(least(1e0, sqrt(pow(sin(radians({b}.dec-{a}.dec)/2e0),2)"
        f"+cos(radians({a}.dec))*cos(radians({b}.dec))*pow(sin(radians({b}.ra-{a}.ra)/2e0),2)))))"
    )


def _near(a: str, b: str, arcsec: float) -> str:
    return (
        f"{b}.dec BETWEEN {a}.dec - {arcsec}e0/36e2*1.01e0 AND {a}.dec + {arcsec}e0/36e2*1.01e0"
        f" AND {_apart(a, b)}*36e2 < {arcsec}e0"
    )


def _duplicates(source: str, key: str, by: str | None = None, earlier: bool = False) -> str:
    same = f" AND a.{by}=b.{by}" if by else ""
    other = f"b.{key}<a.{key}" if earlier else f"a.{key}<>b.{key}"
    return f"SELECT DISTINCT a.{key} FROM {source} a JOIN {source} b ON {other}{same} AND {_near('a', 'b', 0.3)}"


def _nearest(left: str, right: str, lkey: str, rkey: str, arcsec: float, payload: str = "") -> str:
    return (
        f"SELECT * FROM (SELECT a.{lkey}, b.{rkey}, {_apart('a', 'b')} AS d2d{payload},"
        f" row_number() OVER (PARTITION BY a.{lkey} ORDER BY {_apart('a', 'b')}, b.{rkey}) AS rn"
        f" FROM {left} a JOIN {right} b ON {_near('a', 'b', arcsec)}) WHERE rn=1"
    )


PHOT_CUT = "snr_r>1e1 AND snr_r<5e2 AND fwhm_r*36e2>8e-1 AND mag_r<3e1 AND magerr_r<5e-1"
CUT_CTE = f"{ctes('phot')}, cut AS (SELECT * FROM phot WHERE {PHOT_CUT})"
LONELY = "SELECT tile FROM cut GROUP BY tile HAVING count(*)=1"
USABLE_CTE = (
    f"{CUT_CTE}, dup AS ({_duplicates('cut', 'obj_id', 'tile')}),"
    f" usable AS (SELECT * FROM cut WHERE obj_id NOT IN (SELECT obj_id FROM dup) AND tile NOT IN ({LONELY}))"
)
SPECTRA_CTE = (
    f"{ctes('spec')}, pos AS (SELECT * FROM spec WHERE z_spec>0e0), sdup AS ({_duplicates('pos', 'spec_id')}),"
    " spectra AS (SELECT * FROM pos WHERE spec_id NOT IN (SELECT spec_id FROM sdup))"
)

# --- tiles in SQL --------------------------------------------------------------------------

BAND_VIEWS = tuple(f"band_{b.lower()}" for b in BANDS)
DET_CUT = "r.SNR_WIN>1e1 AND r.SNR_WIN<5e2 AND r.FWHM_WORLD*36e2>8e-1 AND r.MAG_AUTO<3e1 AND r.MAGERR_AUTO<5e-1"


def _tile_ctes(views: tuple[str, ...] = BAND_VIEWS) -> str:
    return (
        f"{ctes(*views)}, det AS (SELECT tile, ide, X_WORLD AS ra, Y_WORLD AS dec FROM band_r r WHERE {DET_CUT}),"
        f" ddup AS ({_duplicates('det', 'ide', 'tile')}),"
        " lonely AS (SELECT tile FROM det GROUP BY tile HAVING count(*)=1),"
        " usable AS (SELECT * FROM det WHERE ide NOT IN (SELECT ide FROM ddup) AND tile NOT IN (SELECT tile FROM lonely))"
    )


JOINED = (
    " FROM usable u JOIN band_r r ON r.tile=u.tile AND r.ide=u.ide"
    " JOIN band_i i ON i.tile=u.tile AND i.ide=u.ide JOIN band_z z ON z.tile=u.tile AND z.ide=u.ide"
)
BAND_CUT = " AND ".join(
    f"{b}.SNR_WIN>1e1 AND {b}.SNR_WIN<5e2 AND {b}.FWHM_WORLD*36e2>8e-1 AND {b}.MAGERR_AUTO<5e-1" for b in "riz"
)
NAME = "concat(substr(u.tile,5,length(u.tile)-9),'_',CAST(u.ide AS VARCHAR)) AS NAME"


def _mag(band: str) -> str:
    return f"CASE WHEN {band}.MAG_AUTO>98e0 THEN NULL ELSE {band}.MAG_AUTO END - 5e0 AS MAG_AUTO_{band.upper()}"


MAGS = f"r.MAG_AUTO AS MAG_AUTO_R, {_mag('i')}, {_mag('z')}"
ERRS = ", ".join(f"{b}.MAGERR_AUTO AS MAGERR_AUTO_{b.upper()}" for b in "riz")
PLACE = "u.tile, u.ide, u.ra AS RA, u.dec AS DEC, r.FWHM_WORLD AS FWHM, r.ELONGATION AS ELONGATION"
WINS = ", ".join(
    ["r.MAG_WIN AS MAG_WIN_R"]
    + [f"CASE WHEN {b}.MAG_WIN>98e0 THEN NULL ELSE {b}.MAG_WIN END AS MAG_WIN_{b.upper()}" for b in "iz"]
    + [f"{b}.{p} AS {p}_{b.upper()}" for p in ("MAGERR_WIN", "FLUX_AUTO", "FLUXERR_AUTO", "FLUX_WIN",
                                              "FLUXERR_WIN", "FLUX_APER", "FLUXERR_APER") for b in "riz"]
)
SHAPES = ", ".join(
    f"m.{c}" for c in ("gal_mag", "gal_mag_err", "gal_flux", "gal_flux_err", "gal_g1", "gal_g1_err", "gal_g2",
                       "gal_g2_err", "gal_gini", "gal_sb", "gal_rho4", "gal_sigma", "gal_resolution", "psf_sigma")
)
MATCHED_CTE = (
    f"{_tile_ctes()}, {ctes('morph')}, matched AS (SELECT {PLACE}, {NAME}, {MAGS}, {ERRS}, {WINS}, {SHAPES},"
    f" r.Z AS Z_SPEC{JOINED} JOIN morph m ON m.tile=u.tile AND m.id=r.NUMBER"
    f" WHERE {BAND_CUT} AND m.gal_mag_err<5e-1 AND r.Z>0e0)"
)
UNMATCHED_CTE = (
    f"{_tile_ctes()}, unmatched AS (SELECT {PLACE}, {NAME}, r.NUMBER AS id, {MAGS}, {ERRS}{JOINED} WHERE {BAND_CUT})"
)
CROSS_CTE = (
    f"{_tile_ctes()}, {SPECTRA_CTE}, pairs AS ({_nearest('usable', 'spectra', 'ide', 'spec_id', 0.3, ', b.z_spec')}),"
    f" crossed AS (SELECT {PLACE}, {NAME}, {MAGS}, {ERRS}, p.z_spec AS Z_SPEC{JOINED} JOIN pairs p ON p.ide=u.ide"
    f" WHERE {BAND_CUT})"
)


def _merged(name: str) -> str:
    """A catalogue without objects close to another one, whatever their tile."""
    return (
        f"{name}_dup AS ({_duplicates(name, 'ide')}),"
        f" {name}_merged AS (SELECT * FROM {name} WHERE ide NOT IN (SELECT ide FROM {name}_dup))"
    )


# --- Spark side ----------------------------------------------------------------------------

def phot(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "phot").withColumnsRenamed({"ra": "RA", "dec": "DEC"})


def phot_cut(spark: SparkSession, sf: str, cfg: SurveyConfig = CAPPED) -> DataFrame:
    return cuts.detection_cut(phot(spark, sf), cfg, "snr_r", "fwhm_r", "mag_r", "magerr_r")


def spec(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "spec").withColumnsRenamed({"ra": "RA", "dec": "DEC", "z_spec": "Z_SPEC"})


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    return catalogues.spectroscopic_catalogue(spec(spark, sf), ["spec_id"])


def bands(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {b: view(spark, sf, f"band_{b.lower()}") for b in BANDS}


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return catalogues.matched_tiles(bands(spark, sf), view(spark, sf, "morph"), CAPPED)


def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return catalogues.unmatched_tiles(bands(spark, sf), CAPPED)


def lower(df: DataFrame) -> DataFrame:
    """Positions under the names the SQL uses."""
    return df.withColumnsRenamed({"RA": "ra", "DEC": "dec", "Z_SPEC": "z_spec"})


def arcsec(df: DataFrame) -> DataFrame:
    return df.withColumn("d2d_arcsec", F.round(F.col("d2d") * 3600, 6)).drop("d2d")


def crossmatch_query(spark: SparkSession, sf: str) -> DataFrame:
    good = phot_cut(spark, sf)
    kept = dedup.separated(good, ["obj_id"], by=["tile"]).join(
        cuts.lonely_objects(good, "obj_id"), ["tile", "obj_id"], "left_anti"
    )
    usable = staged(good.join(kept, ["tile", "obj_id"], "left_semi").select("obj_id", "RA", "DEC", "mag_r"))
    pairs = crossmatch.nearest(usable, spectra(spark, sf), 0.3, ["obj_id"], "spec_id", ["Z_SPEC"], right_separated=True)
    joined = usable.select("obj_id", "mag_r").join(pairs, "obj_id")
    return lower(arcsec(cuts.positive(joined))).select("obj_id", "spec_id", "d2d_arcsec", "z_spec", "mag_r")


def match_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = catalogues.distance_table(bands(spark, sf), spectra(spark, sf), CAPPED, "spec_id")
    return lower(arcsec(out))


def index(df: DataFrame, key: str, radius: float, payload=(), coords: tuple[str, str] = ("RA", "DEC")) -> sky_index.SkyIndex:
    return sky_index.write(df, f"{shared_folder(df.sparkSession)}/sky-{uuid.uuid4().hex}", key, radius, payload, coords)


def nearest_stored(spark: SparkSession, sf: str, crowd: str = "", payload=()) -> DataFrame:
    """Search in a stored catalogue."""
    plain = ("ra", "dec")
    stored = index(view(spark, sf, f"deep{crowd}"), "deep_id", 0.5, payload, plain)
    return arcsec(stored.nearest(view(spark, sf, f"u_survey{crowd}"), 0.3, ["u_id"], left_coords=plain))


def survey_base(spark: SparkSession, sf: str, stored: bool = False) -> DataFrame:
    """u survey with its deep-survey partners."""
    u = view(spark, sf, "u_survey").withColumnsRenamed(
        {"ra": "ALPHA_J2000", "dec": "DELTA_J2000", "mag_u": "MAG_u", "mag_r_u": "MAG_r", "magerr_u": "MAGERR_u"}
    )
    deep = surveys.deep_survey(view(spark, sf, "deep").withColumnsRenamed(
        {f"{b}{e}": f"{b}_stk_aper{e}" for b in "giz" for e in ("", "_err")}
    ))
    if stored:
        deep = index(deep, "deep_id", surveys.TOLERANCE, surveys.DEEP_COLUMNS)
    return staged(surveys.u_with_deep(surveys.u_survey(u), deep))


def three_matched(spark: SparkSession, sf: str, morphology: bool = True) -> tuple[DataFrame, DataFrame]:
    merged = catalogues.merge_tiles(matched(spark, sf), CAPPED)
    return surveys.with_redshift(survey_base(spark, sf), merged, "ide", morphology)


def three_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    merged = catalogues.merge_tiles(unmatched(spark, sf), CAPPED)
    return surveys.without_redshift(survey_base(spark, sf), merged, "ide")


def three_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The chain on stored catalogues."""
    merged = catalogues.merge_tiles(matched(spark, sf), CAPPED)
    offered = [c for c in surveys.R_COLUMNS if c in merged.columns]
    return surveys.with_redshift(
        survey_base(spark, sf, stored=True), index(merged, "ide", surveys.TOLERANCE, offered), "ide")[0]


THREE_CTE = (
    f"{ctes('u_survey', 'deep')}, uu AS (SELECT u_id, CASE WHEN ra NOT IN (-99e0,99e0,0e0) THEN ra END AS ra,"
    " CASE WHEN dec NOT IN (-99e0,99e0,0e0) THEN dec END AS dec, CASE WHEN mag_u NOT IN (-99e0,99e0,0e0) THEN mag_u END AS MAG_u,"
    " CASE WHEN mag_r_u NOT IN (-99e0,99e0,0e0) THEN mag_r_u END AS MAG_r FROM u_survey"
    " WHERE magerr_u NOT IN (-99e0,99e0,0e0) AND magerr_u<5e-1),"
    " dd AS (SELECT * FROM deep WHERE g_err<5e-1 AND i_err<5e-1 AND z_err<5e-1),"
    f" ud AS ({_nearest('uu', 'dd', 'u_id', 'deep_id', 0.3, ', a.ra, a.dec, a.MAG_u, a.MAG_r, b.g, b.i, b.z')})"
)
BASE_NAMES = 'm.MAG_AUTO_R AS r, ud.MAG_u AS u, ud.i AS i, ud.z AS z, ud.g AS g'
SHAPE_NAMES = (
    'm.gal_sb AS "Surf. bright.", m.gal_rho4 AS "Rho4", m.gal_sigma AS "Galaxy size",'
    ' m.gal_gini AS "Gini index", m.ELONGATION AS "Elongation"'
)


def _chain(catalogue_cte: str, name: str, select: str) -> str:
    return (
        f"WITH {catalogue_cte}, {_merged(name)}, {THREE_CTE},"
        f" last AS ({_nearest('ud', name + '_merged', 'u_id', 'ide', 0.3)})"
        f" SELECT l.u_id, {select} FROM last l JOIN ud ON ud.u_id=l.u_id JOIN {name}_merged m ON m.ide=l.ide"
    )


def distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    merged = catalogues.merge_distances(
        catalogues.distance_table(bands(spark, sf), spectra(spark, sf), CAPPED, "spec_id"), CAPPED
    )
    in_arcsec = merged.withColumn("d2d_arcsec", F.col("d2d") * 3600)
    return histogram.histogram(in_arcsec, "d2d_arcsec", 100, (0.0, 2.0)).select("bin", "cnt")


DISTANCE_CTE = (
    f"{_tile_ctes()}, {SPECTRA_CTE}, whole AS (SELECT u.* FROM usable u JOIN band_i i ON i.tile=u.tile AND i.ide=u.ide"
    " JOIN band_z z ON z.tile=u.tile AND z.ide=u.ide),"
    f" pairs AS ({_nearest('whole', 'spectra', 'ide', 'spec_id', 2.0)}),"
    " distances AS (SELECT w.tile, w.ide, w.ra, w.dec, p.spec_id, p.d2d,"
    " coalesce(p.d2d*36e2 < 3e-1, false) AS ismatched FROM whole w LEFT JOIN pairs p ON p.ide=w.ide)"
)


def spectroscopic_union(spark: SparkSession, sf: str) -> DataFrame:
    second = view(spark, sf, "spec_b").withColumnsRenamed({"ra": "RA", "dec": "DEC", "z_spec": "Z_SPEC"})
    both = tables.union_tables([
        spectra(spark, sf).withColumn("survey", F.lit("a")),
        catalogues.spectroscopic_catalogue(second, ["spec_id"]).withColumn("survey", F.lit("b")),
    ])
    return lower(both)


UNION_CTE = (
    f"{SPECTRA_CTE}, {ctes('spec_b')}, pos2 AS (SELECT * FROM spec_b WHERE z_spec>0e0),"
    f" sdup2 AS ({_duplicates('pos2', 'spec_id')}), both_spec AS (SELECT *, 'a' AS survey FROM spectra UNION ALL"
    " SELECT *, 'b' AS survey FROM pos2 WHERE spec_id NOT IN (SELECT spec_id FROM sdup2))"
)


def redshift_median(spark: SparkSession, sf: str) -> DataFrame:
    both = spectroscopic_union(spark, sf)
    value = order_stats.medians(both, ["z_spec"])["z_spec"]
    return both.agg(F.count("z_spec").alias("n")).withColumn("median_z", F.lit(value))


def tile_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = catalogues.spectra_for_tiles(bands(spark, sf), spectra(spark, sf), CAPPED, "spec_id")
    full = unmatched(spark, sf).select("tile", "ide", "MAG_AUTO_R").join(
        found.select("tile", "ide", "Z_SPEC"), ["tile", "ide"], "left"
    )
    out = statistics.tile_statistics(full)
    return out.withColumn("corr_mag_z", F.round("corr_mag_z", 8))


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """u survey with sentinels as NULL and the error cut."""
    u = project.external_sentinels(view(spark, sf, "u_all"), ["ra", "dec", "mag_u", "mag_r_u", "magerr_u"])
    return cuts.errors_below(u, ["magerr_u"])


IMAGE_SQL = "list_transform(e.embedding, lambda x: round(CAST(x AS DOUBLE),6))"


def tile_images(spark: SparkSession, sf: str) -> DataFrame:
    """Cut-outs of the objects that have one, from the band tables through cuts and merge."""
    cut_out = read(spark, sf, "embeddings").select(F.col("vec_id").alias("ide"), pixels.as_image(F.col("embedding"), 8).alias("VIGNET"))
    tables_ = {b: t.join(cut_out, "ide", "left") for b, t in bands(spark, sf).items()}
    merged = catalogues.merge_tiles(catalogues.unmatched_tiles(tables_, CAPPED, images=["VIGNET"]), CAPPED)
    def flat(c):
        return F.transform(F.flatten(c), lambda x: F.round(x.cast("double"), 6))
    return merged.select("tile", "ide", flat("VIGNET_R").alias("pixels_r"), flat("VIGNET_Z").alias("pixels_z"))


QUERIES = {
    "spec_catalog": lambda s, d: lower(spectra(s, d)),
    "quality_cut": lambda s, d: lower(phot_cut(s, d)),
    "quality_cut_open": lambda s, d: lower(phot_cut(s, d, OPEN)),
    "dup_flags": lambda s, d: dedup.flag_duplicates(phot(s, d), ["obj_id"]).select("obj_id", "isdup"),
    "dedup": lambda s, d: lower(dedup.drop_duplicates_on_sky(phot_cut(s, d), ["obj_id"], by=["tile"])),
    "dedup_keep_first": lambda s, d: dedup.separated(phot(s, d), ["obj_id"], policy="keep_first"),
    "crossmatch": crossmatch_query,
    "nearest_any": lambda s, d: arcsec(crossmatch.nearest(
        view(s, d, "u_survey"), view(s, d, "deep"), 0.3, ["u_id"], "deep_id", ["g"], ("ra", "dec"), ("ra", "dec"))),
    "nearest_crowded": lambda s, d: arcsec(crossmatch.nearest(
        view(s, d, "u_survey_crowd"), view(s, d, "deep_crowd"), 0.3, ["u_id"], "deep_id", (), ("ra", "dec"), ("ra", "dec"))),
    "nearest_indexed": lambda s, d: nearest_stored(s, d, payload=["g"]),
    "nearest_indexed_crowded": lambda s, d: nearest_stored(s, d, "_crowd"),
    "three_survey_indexed": three_stored,
    "tile_images": tile_images,
    "match_distance": match_distance,
    "distance_histogram": distance_histogram,
    "merge_distance": lambda s, d: arcsec(catalogues.merge_distances(
        catalogues.distance_table(bands(s, d), spectra(s, d), CAPPED, "spec_id"), CAPPED)),
    "tile_matched": lambda s, d: matched(s, d),
    "tile_unmatched": lambda s, d: unmatched(s, d),
    "tile_crossmatched": lambda s, d: catalogues.spectra_for_tiles(bands(s, d), spectra(s, d), CAPPED, "spec_id"),
    "tile_stats": tile_stats,
    "merge_tiles": lambda s, d: catalogues.merge_tiles(matched(s, d), CAPPED),
    "merge_unmatched": lambda s, d: catalogues.merge_tiles(unmatched(s, d), CAPPED),
    "three_survey_matched": lambda s, d: three_matched(s, d)[0],
    "three_survey_matched_plain": lambda s, d: three_matched(s, d, morphology=False)[0],
    "three_survey_unmatched": lambda s, d: three_unmatched(s, d),
    "r_vs_r": lambda s, d: three_matched(s, d)[1],
    "external_sentinels": lookups,
    "spec_union": spectroscopic_union,
    "redshift_median": redshift_median,
    "rename_matched": lambda s, d: project.rename_matched(
        matched(s, d).withColumn("MAG_AUTO_U", F.col("MAG_WIN_R")), keep=["tile", "ide"]),
    "rename_unmatched": lambda s, d: project.rename_unmatched(
        unmatched(s, d).withColumn("MAG_AUTO_U", F.col("MAG_AUTO_R")), keep=["tile", "ide"]),
    "shear": lambda s, d: project.shear(view(s, d, "morph_all").select("tile", "id", "gal_g1", "gal_g2")),
}

ORACLES = {
    "spec_catalog": f"WITH {SPECTRA_CTE} SELECT * FROM spectra",
    "quality_cut": f"WITH {CUT_CTE} SELECT * FROM cut",
    "quality_cut_open": f"WITH {ctes('phot')} SELECT * FROM phot WHERE snr_r>1e1 AND fwhm_r*36e2>8e-1"
                        " AND mag_r<3e1 AND magerr_r<5e-1",
    "dup_flags": f"WITH {ctes('phot')}, dup AS ({_duplicates('phot', 'obj_id')}) SELECT obj_id,"
                 " obj_id IN (SELECT obj_id FROM dup) AS isdup FROM phot",
    "dedup": f"WITH {CUT_CTE}, dup AS ({_duplicates('cut', 'obj_id', 'tile')})"
             " SELECT * FROM cut WHERE obj_id NOT IN (SELECT obj_id FROM dup)",
    "dedup_keep_first": f"WITH {ctes('phot')}, dup AS ({_duplicates('phot', 'obj_id', earlier=True)})"
                        " SELECT obj_id FROM phot WHERE obj_id NOT IN (SELECT obj_id FROM dup)",
    "crossmatch": f"WITH {USABLE_CTE}, {SPECTRA_CTE}, pairs AS"
                  f" ({_nearest('usable', 'spectra', 'obj_id', 'spec_id', 0.3, ', b.z_spec, a.mag_r')})"
                  " SELECT obj_id, spec_id, round(d2d*36e2,6) AS d2d_arcsec, z_spec, mag_r FROM pairs WHERE z_spec>0e0",
    "nearest_any": f"WITH {ctes('u_survey', 'deep')}, pairs AS"
                   f" ({_nearest('u_survey', 'deep', 'u_id', 'deep_id', 0.3, ', b.g')})"
                   " SELECT u_id, deep_id, g, round(d2d*36e2,6) AS d2d_arcsec FROM pairs",
    "match_distance": f"WITH {DISTANCE_CTE} SELECT tile, ide, ra, dec, spec_id, round(d2d*36e2,6) AS d2d_arcsec,"
                      " ismatched FROM distances",
    "merge_distance": f"WITH {DISTANCE_CTE}, {_merged('distances')} SELECT tile, ide, spec_id,"
                      " round(d2d*36e2,6) AS d2d_arcsec, ismatched FROM distances_merged",
    "distance_histogram": f"WITH {DISTANCE_CTE}, {_merged('distances')}, b AS (SELECT least(99,"
                          " CAST(floor(d2d*36e2/2e-2) AS BIGINT)) AS bin FROM distances_merged"
                          " WHERE d2d*36e2 BETWEEN 0e0 AND 2e0) SELECT CAST(s.bin AS BIGINT) AS bin, count(b.bin) AS cnt"
                          " FROM range(100) s(bin) LEFT JOIN b ON b.bin=s.bin GROUP BY s.bin",
    "tile_matched": f"WITH {MATCHED_CTE} SELECT * FROM matched",
    "tile_unmatched": f"WITH {UNMATCHED_CTE} SELECT * FROM unmatched",
    "tile_crossmatched": f"WITH {CROSS_CTE} SELECT * FROM crossed",
    "tile_stats": f"WITH {CROSS_CTE}, allrows AS (SELECT u.tile, u.ide, r.MAG_AUTO AS m{JOINED} WHERE {BAND_CUT})"
                  " SELECT a.tile, count(*) AS total, count(c.Z_SPEC) AS matched,"
                  " round(corr(CASE WHEN c.Z_SPEC IS NOT NULL THEN a.m END, c.Z_SPEC),8) AS corr_mag_z"
                  " FROM allrows a LEFT JOIN crossed c ON c.ide=a.ide GROUP BY a.tile",
    "merge_tiles": f"WITH {MATCHED_CTE}, {_merged('matched')} SELECT * FROM matched_merged",
    "merge_unmatched": f"WITH {UNMATCHED_CTE}, {_merged('unmatched')} SELECT * FROM unmatched_merged",
    "three_survey_matched": _chain(MATCHED_CTE, "matched", f'{BASE_NAMES}, {SHAPE_NAMES}, m.Z_SPEC AS "Z spec"'),
    "three_survey_matched_plain": _chain(MATCHED_CTE, "matched", f'{BASE_NAMES}, m.Z_SPEC AS "Z spec"'),
    "three_survey_unmatched": _chain(UNMATCHED_CTE, "unmatched", BASE_NAMES),
    "r_vs_r": _chain(MATCHED_CTE, "matched", "ud.MAG_r AS MAG_r, m.MAG_AUTO_R AS MAG_AUTO_R"),
    "external_sentinels": f"WITH {ctes('u_all')} SELECT u_id, " + ", ".join(
        f"CASE WHEN {c} NOT IN (-99e0,99e0,0e0) THEN {c} END AS {c}" for c in ("ra", "dec", "mag_u", "mag_r_u", "magerr_u")
    ) + " FROM u_all WHERE magerr_u NOT IN (-99e0,99e0,0e0) AND magerr_u<5e-1",
    "spec_union": f"WITH {UNION_CTE} SELECT * FROM both_spec",
    "redshift_median": f"WITH {UNION_CTE} SELECT count(z_spec) AS n, median(z_spec) AS median_z FROM both_spec",
    "rename_matched": f'WITH {MATCHED_CTE} SELECT tile, ide, m.MAG_AUTO_R AS r, m.MAG_WIN_R AS u, m.MAG_AUTO_I AS i,'
                      f' m.MAG_AUTO_Z AS z, {SHAPE_NAMES}, m.Z_SPEC AS "Z spec" FROM matched m',
    "rename_unmatched": f"WITH {UNMATCHED_CTE} SELECT tile, ide, MAG_AUTO_R AS r, MAG_AUTO_R AS u, MAG_AUTO_I AS i,"
                        " MAG_AUTO_Z AS z FROM unmatched",
    "shear": f"WITH {ctes('morph_all')} SELECT tile, id, abs(gal_g1+gal_g2) AS gal_g FROM morph_all",
    "nearest_crowded": f"WITH {ctes('u_survey_crowd', 'deep_crowd')}, pairs AS"
                       f" ({_nearest('u_survey_crowd', 'deep_crowd', 'u_id', 'deep_id', 0.3)})"
                       " SELECT u_id, deep_id, round(d2d*36e2,6) AS d2d_arcsec FROM pairs",
    "tile_images": f"WITH {UNMATCHED_CTE}, {_merged('unmatched')} SELECT m.tile, m.ide, {IMAGE_SQL} AS pixels_r, {IMAGE_SQL} AS pixels_z"
                   " FROM unmatched_merged m LEFT JOIN embeddings e ON e.vec_id=m.ide",
}
# The same rows from stored catalogues.
ORACLES |= {
    "nearest_indexed": ORACLES["nearest_any"],
    "nearest_indexed_crowded": ORACLES["nearest_crowded"],
    "three_survey_indexed": ORACLES["three_survey_matched"],
}
