"""Round trips of the given tables through the writers and readers, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from checks.fixtures import ctes, read, view
from skylattice.operators import pixels
from skylattice.session import shared_folder
from skylattice.sources import fits, tables


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


def u_survey(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated survey."""
    path = _folder(spark)
    u = view(spark, sf, "u_survey").select(
        "u_id", F.col("mag_u").alias("MAG_u"), F.col("ra").alias("ALPHA_J2000"), F.col("magerr_u").alias("MAGERR_u"),
        F.col("dec").alias("DELTA_J2000"), F.col("mag_r_u").alias("MAG_r"))
    tables.write_table(u, path, fmt="csv", sep="\t")
    return tables.read_u_survey(spark, path)


def deep_survey(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated survey in two folders whose files have their columns in another order."""
    path = _folder(spark)
    deep = view(spark, sf, "deep").select(
        "deep_id", "ra", "dec", *[F.col(b).alias(f"{b}_stk_aper") for b in "giz"], *[F.col(f"{b}_err").alias(f"{b}_stk_aper_err") for b in "giz"])
    tables.write_table(deep.filter("deep_id % 2 = 0"), f"{path}/even", fmt="csv")
    tables.write_table(deep.filter("deep_id % 2 = 1").select(*reversed(deep.columns)), f"{path}/odd", fmt="csv")
    return tables.read_deep_survey(spark, path)


def spectra(fmt: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = _folder(spark)
        s = view(spark, sf, "spec").select(
            "ra", "dec", F.when(F.col("z_spec") > 0, F.col("z_spec")).otherwise(F.lit(float("nan"))).alias("z"))
        tables.write_table(s, path, fmt=fmt)
        return tables.read_spectroscopic(spark, path, fmt)
    return query


TILE = StructType([StructField("ide", LongType()), StructField("MAG_AUTO", DoubleType()), StructField("tile", StringType())])


def tiles(fmt: str):
    """A directory with one folder for each tile, or delimited files that carry it."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = _folder(spark)
        t = view(spark, sf, "band_i").select("tile", "ide", "MAG_AUTO")
        tables.write_table(t, path, ["tile"] if fmt == "parquet" else [], fmt)
        return tables.read_tiles(spark, path, None if fmt == "parquet" else TILE, fmt).select("tile", "ide", "MAG_AUTO")
    return query


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights stored beside a table, for some of its rows."""
    path = _folder(spark)
    t = view(spark, sf, "train").select("obj_id", "r")
    tables.write_table(t.filter("obj_id % 3 > 0").select("obj_id", (F.col("r") / 2).alias("weight")), path)
    return tables.join_weights(t, tables.as_table(spark, path=path), ["obj_id"])


def fits_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as arrays of variable length, through binary tables with a heap."""
    path = _folder(spark)
    lines = read(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", F.col("l_extendedprice").cast("double").alias("price"), "l_partkey", "l_returnflag").alias("line"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("lines.price").alias("prices"),
        F.transform("lines", lambda x: F.when(x["l_partkey"] % 3 > 0, x["l_partkey"].cast("bigint"))).alias("parts"),
        F.array_join("lines.l_returnflag", "").alias("flags"),
        F.when(F.col("l_orderkey") % 5 > 0, F.size("lines")).alias("n"))
    fits.write_fits(orders, path, "LINES", filebytes=1 << 20)
    return fits.read_fits(spark, path, "LINES").select("l_orderkey", "n", "flags", "parts", F.transform("prices", lambda x: F.round(x, 2)).alias("prices"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Cut-outs carried as arrays."""
    path = _folder(spark)
    e = read(spark, sf, "embeddings").select("vec_id", pixels.as_image(F.col("embedding"), 8).alias("image"))
    tables.write_table(e, path)
    return tables.read_table(spark, path).select(
        "vec_id", F.size("image").alias("height"), F.transform(F.flatten("image"), lambda x: F.round(x.cast("double"), 6)).alias("pixels"))


def survey_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored catalogues with different columns as one table."""
    a, b = _folder(spark), _folder(spark)
    tables.write_table(view(spark, sf, "spec").select("spec_id", "z_spec"), a)
    tables.write_table(view(spark, sf, "spec_b").select("spec_id", "ra"), b)
    return tables.union_tables([tables.read_table(spark, a), tables.read_table(spark, b)])


QUERIES = {
    "round_trip_u_survey": u_survey,
    "round_trip_deep_survey": deep_survey,
    "round_trip_spectra": spectra("parquet"),
    "round_trip_spectra_text": spectra("csv"),
    "round_trip_tiles": tiles("parquet"),
    "round_trip_tiles_text": tiles("csv"),
    "round_trip_weights": weights,
    "round_trip_images": images,
    "round_trip_fits": fits_orders,
    "round_trip_union": survey_union,
}

_SPECTRA = f"WITH {ctes('spec')} SELECT ra AS \"RA\", dec AS \"DEC\", CASE WHEN z_spec>0 THEN z_spec END AS \"Z_SPEC\" FROM spec"
_TILES = f"WITH {ctes('band_i')} SELECT tile, ide, MAG_AUTO AS \"MAG_AUTO\" FROM band_i"

ORACLES = {
    "round_trip_fits": "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CASE WHEN l_orderkey%5>0 THEN CAST(count(*) AS INTEGER) END AS n,"
                       " string_agg(l_returnflag, '' ORDER BY l_linenumber, l_extendedprice, l_partkey, l_returnflag) AS flags,"
                       " list(CASE WHEN l_partkey%3>0 THEN CAST(l_partkey AS BIGINT) END ORDER BY l_linenumber, l_extendedprice, l_partkey, l_returnflag) AS parts,"
                       " list(round(CAST(l_extendedprice AS DOUBLE),2) ORDER BY l_linenumber, l_extendedprice, l_partkey, l_returnflag) AS prices FROM lineitem GROUP BY l_orderkey",
    "round_trip_u_survey": f"WITH {ctes('u_survey')} SELECT ra AS \"ALPHA_J2000\", dec AS \"DELTA_J2000\", mag_u AS \"MAG_u\", mag_r_u AS \"MAG_r\","
                           " magerr_u AS \"MAGERR_u\" FROM u_survey",
    "round_trip_deep_survey": f"WITH {ctes('deep')} SELECT ra, dec, g AS g_stk_aper, i AS i_stk_aper, z AS z_stk_aper,"
                              " g_err AS g_stk_aper_err, i_err AS i_stk_aper_err, z_err AS z_stk_aper_err FROM deep",
    "round_trip_spectra": _SPECTRA,
    "round_trip_spectra_text": _SPECTRA,
    "round_trip_tiles": _TILES,
    "round_trip_tiles_text": _TILES,
    "round_trip_weights": f"WITH {ctes('train')} SELECT obj_id, r, CASE WHEN obj_id%3>0 THEN r/2e0 END AS weight FROM train",
    "round_trip_images": "SELECT vec_id, CAST(8 AS INTEGER) AS height, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE),6)) AS pixels FROM embeddings",
    "round_trip_union": f"WITH {ctes('spec', 'spec_b')} SELECT spec_id, z_spec, CAST(NULL AS DOUBLE) AS ra FROM spec"
                        " UNION ALL SELECT spec_id, NULL, ra FROM spec_b",
}
