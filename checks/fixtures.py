"""Catalogues derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Every view is a row-wise projection (at most with a filter) of one table, so its size follows
the table. Literals are doubles (``1e4``): decimal literals differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def ra(key: str) -> str:
    return f"((({key})*7919)%3600000)/1e4"


def dec(key: str) -> str:
    """Every 3.6 million keys the pattern lies 3.6 arcsec further north, so positions stay distinct."""
    return f"((({key})*104729)%1200000)/1e4-6e1+floor(({key})/3.6e6)*1e-3"


# keys ending in 7 share the position of the key before, 0.18 arcsec further north
PAIR_KEY = "o_orderkey - CASE WHEN o_orderkey%10=7 THEN 1 ELSE 0 END"
PAIR_SHIFT = "CASE WHEN o_orderkey%10=7 THEN 5e-5 ELSE 0e0 END"
TILE = "concat('cat_', CAST(o_custkey%16 AS STRING), '.fits')"

# band -> (offset of the brightness, multiplier of the brightness, key step of the 99 sentinel)
BANDS = {"R": (18, 37, 0), "I": (17, 41, 23), "Z": (18, 61, 29)}


def _band(band: str) -> str:
    base, step, sentinel = BANDS[band]
    mag = f"{base}e0+(o_orderkey*{step}%700)/1e2"
    if sentinel:
        mag = f"CASE WHEN o_orderkey%{sentinel}=0 THEN 9.9e1 ELSE {mag} END"
    return f"""SELECT {TILE} AS tile, o_orderkey AS ide, o_orderkey AS NUMBER,
 {ra(PAIR_KEY)} AS X_WORLD, {dec(PAIR_KEY)} + {PAIR_SHIFT} AS Y_WORLD,
 1e0+(o_orderkey*7%300)/1e2 AS ELONGATION,
 1.05e1+(o_orderkey*{step - 6}%5000)/1e1 AS SNR_WIN, (70+o_orderkey*{step - 20}%200)/3.6e5 AS FWHM_WORLD,
 {mag} AS MAG_AUTO, (o_orderkey*{step - 24}%60)/1e2 AS MAGERR_AUTO,
 {mag} + 1e-1 AS MAG_WIN, (o_orderkey*{step - 30}%60)/1e2 AS MAGERR_WIN,
 (o_orderkey*{step}%9000)/1e1 AS FLUX_AUTO, (o_orderkey*{step}%90)/1e1 AS FLUXERR_AUTO,
 (o_orderkey*{step + 2}%9000)/1e1 AS FLUX_WIN, (o_orderkey*{step + 2}%90)/1e1 AS FLUXERR_WIN,
 (o_orderkey*{step + 6}%9000)/1e1 AS FLUX_APER, (o_orderkey*{step + 6}%90)/1e1 AS FLUXERR_APER,
 CASE WHEN o_orderkey%9=0 THEN NULL ELSE (o_orderkey*{step}%1500)/1e3-2e-2 END AS Z
 FROM {{orders}} WHERE o_custkey%16<>5 OR '{band}'<>'Z'"""


# Tile 5 has no Z band, so every tile query has to leave it out.
VIEWS = {
    "phot": f"""SELECT o_orderkey AS obj_id, o_custkey%16 AS tile, {ra(PAIR_KEY)} AS ra,
 {dec(PAIR_KEY)} + {PAIR_SHIFT} AS dec,
 1.05e1+(o_orderkey*31%5000)/1e1 AS snr_r, (70+o_orderkey*17%200)/3.6e5 AS fwhm_r,
 1.8e1+(o_orderkey*37%700)/1e2 AS mag_r, (o_orderkey*13%60)/1e2 AS magerr_r,
 CASE WHEN o_orderkey%23=0 THEN 9.9e1 ELSE 1.75e1+(o_orderkey*41%700)/1e2 END AS mag_i FROM {{orders}}""",
    "spec": f"""SELECT c_custkey AS spec_id, {ra('c_custkey*10+3')} AS ra,
 {dec('c_custkey*10+3')} + CASE WHEN c_custkey%3=0 THEN 2e-4 ELSE 4e-5 END AS dec,
 (c_custkey*7%1500)/1e3-1e-2 AS z_spec FROM {{customer}}""",
    "spec_b": f"""SELECT s_suppkey AS spec_id, {ra('s_suppkey*10+3')} AS ra,
 {dec('s_suppkey*10+3')} + 4e-5 AS dec, (s_suppkey*11%900)/1e3 AS z_spec FROM {{supplier}}""",
    "morph": f"""SELECT {TILE} AS tile, o_orderkey AS id, 1.8e1+(o_orderkey*3%600)/1e2 AS gal_mag,
 (o_orderkey*11%70)/1e2 AS gal_mag_err, (o_orderkey*5%700)/1e0 AS gal_flux, (o_orderkey*5%70)/1e0 AS gal_flux_err,
 (o_orderkey*19%200-100)/1e2 AS gal_g1, (o_orderkey*19%20)/1e2 AS gal_g1_err,
 (o_orderkey*23%200-100)/1e2 AS gal_g2, (o_orderkey*23%20)/1e2 AS gal_g2_err,
 (o_orderkey*29%100)/1e2 AS gal_gini, 2e1+(o_orderkey*43%500)/1e2 AS gal_sb,
 (o_orderkey*3%50)/1e1 AS gal_rho4, (o_orderkey*9%80)/1e1 AS gal_sigma,
 (o_orderkey*7%100)/1e2 AS gal_resolution, 7e-1+(o_orderkey*2%30)/1e2 AS psf_sigma
 FROM {{orders}} WHERE o_orderkey%7<>0""",
    "u_survey": f"""SELECT o_orderkey AS u_id, {ra('o_orderkey')} AS ra, {dec('o_orderkey')}+3e-5 AS dec,
 CASE WHEN o_orderkey%29=0 THEN 9.9e1 WHEN o_orderkey%31=0 THEN -9.9e1 ELSE 1.9e1+(o_orderkey*47%600)/1e2 END AS mag_u,
 CASE WHEN o_orderkey%37=0 THEN 9.9e1 ELSE 1.8e1+(o_orderkey*37%700)/1e2+1e-1 END AS mag_r_u,
 (o_orderkey*17%70)/1e2 AS magerr_u FROM {{orders}} WHERE o_orderkey%2=0""",
    "deep": f"""SELECT o_orderkey AS deep_id, {ra('o_orderkey')} AS ra, {dec('o_orderkey')}-2e-5 AS dec,
 1.8e1+(o_orderkey*53%600)/1e2 AS g, 1.8e1+(o_orderkey*59%600)/1e2 AS i, 1.8e1+(o_orderkey*61%600)/1e2 AS z,
 (o_orderkey*3%60)/1e2 AS g_err, (o_orderkey*7%60)/1e2 AS i_err, (o_orderkey*11%60)/1e2 AS z_err
 FROM {{orders}} WHERE o_orderkey%3<>0""",
    "train": """SELECT o_orderkey AS obj_id, 1.8e1+(o_orderkey*37%700)/1e2 AS r,
 CASE WHEN o_orderkey%19=0 THEN -9.9e1 ELSE 1.9e1+(o_orderkey*47%600)/1e2 END AS u,
 CASE WHEN o_orderkey%17=0 THEN NULL ELSE 1.75e1+(o_orderkey*41%700)/1e2 END AS i,
 CASE WHEN o_orderkey%4=0 THEN -1e1 ELSE 1.8e1+(o_orderkey*61%600)/1e2 END AS z,
 1.8e1+(o_orderkey*53%600)/1e2 AS g, (o_orderkey*29%100)/1e2 AS gini,
 5e-2+(o_orderkey*37%700)/1e3+(o_orderkey*41%700)/2e3 AS z_spec FROM {orders}""",
    "population": """SELECT o_orderkey AS obj_id, 1.8e1+(o_orderkey*37%700)/1e2 AS r,
 1.9e1+(o_orderkey*47%600)/1e2 AS u, 1.75e1+(o_orderkey*41%700)/1e2 AS i,
 1.8e1+(o_orderkey*61%600)/1e2 AS z, 1.8e1+(o_orderkey*53%600)/1e2 AS g FROM {orders}""",
    "pred": """SELECT o_orderkey AS obj_id, o_orderkey%4 AS fold, (o_orderkey*37%1500)/1e3 AS y_test,
 (o_orderkey*37%1500)/1e3+(o_orderkey*13%100-50)/1e3+CASE WHEN o_orderkey%25=0 THEN 6e-1 ELSE 0e0 END AS y_pred
 FROM {orders}""",
    **{f"band_{b.lower()}": _band(b) for b in BANDS},
}
# The gaps of these two are a feature of the cross-matches only.
VIEWS["u_all"] = VIEWS["u_survey"].removesuffix(" WHERE o_orderkey%2=0")
VIEWS["morph_all"] = VIEWS["morph"].removesuffix("\n FROM {orders} WHERE o_orderkey%7<>0") + "\n FROM {orders}"
# All objects in a patch of a few square arcseconds.
for _name, _id in (("u_survey", "u_id"), ("deep", "deep_id")):
    VIEWS[f"{_name}_crowd"] = f"SELECT {_id}, ra/1e5 AS ra, dec/1e5 AS dec FROM ({VIEWS[_name]}) t"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived catalogue as a lazy DataFrame."""
    text = VIEWS[name]
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """The same catalogues as common table expressions over the driver's views."""
    plain = {t: t for t in TABLES}
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
