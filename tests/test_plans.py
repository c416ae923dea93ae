"""Whole workflows on small tables."""

import pytest
from pyspark.sql import functions as F

from skylattice.config import MATCHED_PARAMS, MORPHOLOGY_COLUMNS, SurveyConfig
from skylattice.plans import catalogues, surveys

SOURCE = sorted({*MATCHED_PARAMS, "X_WORLD", "Y_WORLD", "ELONGATION"})
GOOD = {"SNR_WIN": 50.0, "FWHM_WORLD": 1.0 / 3600, "MAG_AUTO": 20.0, "MAGERR_AUTO": 0.1, "MAG_WIN": 20.0, "ELONGATION": 1.0}


def band(spark, objects, **changes):
    """objects: (tile, ide, ra, dec, redshift)."""
    rows = []
    for tile, ide, ra, dec, z in objects:
        values = {**dict.fromkeys(SOURCE, 1.0), **GOOD, "X_WORLD": ra, "Y_WORLD": dec, **changes.get(f"o{ide}", {})}
        rows.append((tile, ide, ide + 100, z, *[values[c] for c in SOURCE]))
    return spark.createDataFrame(rows, "tile string, ide bigint, NUMBER bigint, Z double, " + ", ".join(f"{c} double" for c in SOURCE))


def shapes(spark, keys):
    rows = [(t, i + 100, *[0.1] * (len(MORPHOLOGY_COLUMNS) - 1)) for t, i in keys]
    return spark.createDataFrame(rows, "tile string, id bigint, " + ", ".join(f"{c} double" for c in MORPHOLOGY_COLUMNS[1:]))


OBJECTS = [
    ("cat_a.fits", 0, 10.0, 1.0, 0.5), ("cat_a.fits", 1, 10.1, 1.0, 0.6), ("cat_a.fits", 2, 10.1, 1.0 + 5e-5, 0.7),
    ("cat_a.fits", 3, 10.3, 1.0, -0.1), ("cat_a.fits", 4, 10.4, 1.0, None), ("cat_a.fits", 5, 10.5, 1.0, 0.9),
    ("cat_b.fits", 0, 10.0, 1.0, 0.5), ("cat_b.fits", 6, 20.0, 1.0, 0.4),
    ("cat_c.fits", 7, 30.0, 1.0, 0.3),
]


def keys(df):
    return sorted((r["tile"], r["ide"]) for r in df.collect())


@pytest.fixture
def bands(spark):
    return {"R": band(spark, OBJECTS), "I": band(spark, OBJECTS, o5={"MAG_AUTO": 99.0})}


def test_unmatched_tiles(spark, bands):
    out = catalogues.unmatched_tiles(bands, SurveyConfig.open_range(["R", "I"]))
    # 1 and 2 are a close pair, tile c has a single object
    assert keys(out) == [("cat_a.fits", i) for i in (0, 3, 4, 5)] + [("cat_b.fits", i) for i in (0, 6)]
    rows = {(r["tile"], r["ide"]): r for r in out.collect()}
    assert rows[("cat_a.fits", 5)]["MAG_AUTO_I"] is None and rows[("cat_a.fits", 0)]["NAME"] == "a_0"
    assert "SNR_WIN_R" not in out.columns and "SNR" not in out.columns


def test_cut_comes_before_duplicates(spark):
    faint = {"o2": {"SNR_WIN": 5.0}}
    out = catalogues.unmatched_tiles({"R": band(spark, OBJECTS, **faint)}, SurveyConfig.open_range(["R"]))
    assert ("cat_a.fits", 1) in keys(out) and ("cat_a.fits", 2) not in keys(out)


def test_tile_without_a_band_is_left_out(spark):
    bands = {"R": band(spark, OBJECTS), "I": band(spark, [o for o in OBJECTS if o[0] != "cat_b.fits"])}
    out = catalogues.unmatched_tiles(bands, SurveyConfig.open_range(["R", "I"]))
    assert {t for t, _ in keys(out)} == {"cat_a.fits"}
    with pytest.raises(ValueError, match="lacks"):
        catalogues.unmatched_tiles({"R": bands["R"], "I": bands["I"].drop("MAG_AUTO")}, SurveyConfig.open_range(["R", "I"]))


def test_matched_tiles_need_redshift_and_shape(spark, bands):
    morphology = shapes(spark, [("cat_a.fits", i) for i in (0, 1, 2, 3, 4)] + [("cat_b.fits", 6)])
    out = catalogues.matched_tiles(bands, morphology, SurveyConfig.capped_range(["R", "I"]))
    assert keys(out) == [("cat_a.fits", 0), ("cat_b.fits", 6)]
    row = out.filter("ide = 6").first()
    assert row["MAG_AUTO_R"] == 20.0 and row["MAG_AUTO_I"] == 15.0 and row["gal_sb"] == 0.1


def test_detection_band_outside_the_configured_bands(spark, bands):
    out = catalogues.unmatched_tiles(bands, SurveyConfig.open_range(["I"]))
    assert "MAG_AUTO_I" in out.columns and "MAG_AUTO_R" not in out.columns
    assert ("cat_a.fits", 0) in keys(out)


def test_merge_policies(spark, bands):
    cfg = SurveyConfig.open_range(["R", "I"])
    whole = catalogues.unmatched_tiles(bands, cfg)
    # the object at 10.0 is in tiles a and b
    assert [k for k in keys(catalogues.merge_tiles(whole, cfg)) if k[1] == 0] == []
    assert [k for k in keys(catalogues.merge_tiles(whole, cfg, "keep_first")) if k[1] == 0] == [("cat_a.fits", 0)]


def test_spectra_and_distances(spark, bands):
    spec = spark.createDataFrame(
        [(1, 10.0, 1.00004, 0.45), (2, 10.3, 1.0003, 0.2), (3, 50.0, 1.0, -1.0), (4, 60.0, 1.0, 0.2), (5, 60.0, 1.0, 0.3)],
        "sid bigint, RA double, DEC double, Z_SPEC double")
    clean = catalogues.spectroscopic_catalogue(spec, ["sid"])
    assert sorted(r["sid"] for r in clean.collect()) == [1, 2]
    cfg = SurveyConfig.open_range(["R", "I"])
    found = catalogues.spectra_for_tiles(bands, clean, cfg, "sid")
    assert keys(found) == [("cat_a.fits", 0), ("cat_b.fits", 0)] and found.first()["Z_SPEC"] == 0.45
    d = {(r["tile"], r["ide"]): r for r in catalogues.distance_table(bands, clean, cfg, "sid").collect()}
    assert d[("cat_a.fits", 0)]["ismatched"] and not d[("cat_a.fits", 3)]["ismatched"]
    assert d[("cat_a.fits", 3)]["d2d"] * 3600 == pytest.approx(1.08, abs=1e-6) and d[("cat_b.fits", 6)]["d2d"] is None


def test_three_surveys(spark):
    u = spark.createDataFrame(
        [(1, 10.0, 1.0, 21.0, 20.0, 0.1), (2, 11.0, 1.0, 99.0, 20.0, 0.1), (3, 12.0, 1.0, 21.0, 20.0, 0.6), (4, 13.0, 1.0, 22.0, 0.0, 0.1)],
        "u_id bigint, ALPHA_J2000 double, DELTA_J2000 double, MAG_u double, MAG_r double, MAGERR_u double")
    deep = spark.createDataFrame(
        [(i, 9.0 + i, 1.00001, 19.0, 18.0, 17.0, 0.1, 0.1, 0.9 if i == 2 else 0.1) for i in (1, 2, 3, 4)],
        "deep_id bigint, ra double, dec double, g_stk_aper double, i_stk_aper double, z_stk_aper double,"
        " g_stk_aper_err double, i_stk_aper_err double, z_stk_aper_err double")
    r = spark.createDataFrame([(7, 10.0, 1.0, 20.5, 0.3), (8, 13.0, 1.0, 20.6, 0.4)], "ide bigint, RA double, DEC double, MAG_AUTO_R double, Z_SPEC double")
    out = surveys.three_surveys(u, deep, r.filter("ide = 7"), r, "ide", morphology=False)
    assert [tuple(x) for x in out.matched.collect()] == [(1, 20.5, 21.0, 18.0, 17.0, 19.0, 0.3)]
    assert sorted(x["u_id"] for x in out.unmatched.collect()) == [1, 4]
    assert out.r_comparison.first().asDict() == {"u_id": 1, "MAG_r": 20.0, "MAG_AUTO_R": 20.5}
