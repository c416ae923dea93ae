"""Readers and writers of catalogues.

Schemas are explicit, NaN becomes NULL on read, directories are read as one table, and
catalogues are kept in Parquet between the workflow steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Columns of the external survey tables.
U_SURVEY_COLUMNS = ("ALPHA_J2000", "DELTA_J2000", "MAG_u", "MAG_r", "MAGERR_u")
DEEP_SURVEY_COLUMNS = (
    "ra", "dec", "g_stk_aper", "i_stk_aper", "z_stk_aper",
    "g_stk_aper_err", "i_stk_aper_err", "z_stk_aper_err",
)
SPECTROSCOPIC_COLUMNS = ("ra", "dec", "z")


def doubles(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floating})


def header_groups(spark: SparkSession, paths: Sequence[str], sep: str) -> list[tuple[list[str], list[str]]]:
    """Column names of delimited files, with the files that have them in that order.

    One line of each file is read; a directory stands for the files below it.
    """
    context = spark.sparkContext
    hadoop = spark._jsc.hadoopConfiguration()
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        root = context._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(hadoop)
        files = fs.listFiles(root, True)
        while files.hasNext():
            file = files.next().getPath()
            name = file.toString()[len(fs.makeQualified(root).toString()):] or file.getName()
            if any(part.startswith(("_", ".")) for part in name.strip("/").split("/")):
                continue
            stream = context._jvm.java.io.BufferedReader(context._jvm.java.io.InputStreamReader(fs.open(file), "UTF-8"))
            try:
                line = stream.readLine()
            finally:
                stream.close()
            if line is not None:
                names = tuple(n.strip().strip('"') for n in line.removeprefix("\ufeff").split(sep))
                found.setdefault(names, []).append(file.toString())
    return [(list(names), files) for names, files in found.items()]


def read_delimited(spark: SparkSession, paths: Sequence[str], schema: StructType, sep: str = ",", strict: bool = False) -> DataFrame:
    """Columns of ``schema`` by name from delimited files, whatever the order of columns in each.

    Text that is not of the column's type becomes NULL, or raises with ``strict``.
    """
    groups = header_groups(spark, paths, sep)
    if not groups:
        raise ValueError(f"no files in {paths}")
    parts = []
    for names, files in groups:
        lacking = [f.name for f in schema.fields if f.name not in names]
        if lacking:
            raise ValueError(f"columns {lacking} are not in {files[:3]}")
        # every file of the group is checked against these names
        text = StructType([StructField(n, StringType()) for n in names])
        raw = spark.read.schema(text).option("header", True).option("sep", sep).option("enforceSchema", False).csv(files)
        cast = "cast" if strict else "try_cast"
        parts.append(raw.select(*[F.expr(f"{cast}(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields],
                                F.col("_metadata.file_name").alias("_file")))
    return union_tables(parts)


def read_table(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None,
               fmt: str = "parquet", sep: str = ",", strict: bool = False) -> DataFrame:
    """A file, a list of files or a directory as one table.

    Delimited text has a header, columns are picked by name in each file, and it needs a schema:
    without inference the data is read once.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("delimited text needs a schema")
        table = read_delimited(spark, paths, schema, sep, strict).drop("_file")
    else:
        reader = spark.read.format(fmt)
        table = (reader.schema(schema) if schema is not None else reader).load(paths)
    return nan_to_null(table)


def read_spectroscopic(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    """Spectroscopic catalogue with ``RA``, ``DEC``, ``Z_SPEC``."""
    df = read_table(spark, path, doubles(SPECTROSCOPIC_COLUMNS) if fmt == "csv" else None, fmt)
    return df.select(F.col("ra").alias("RA"), F.col("dec").alias("DEC"), F.col("z").alias("Z_SPEC"))


def read_u_survey(spark: SparkSession, path) -> DataFrame:
    """u-band survey, tab-separated."""
    return read_table(spark, path, doubles(U_SURVEY_COLUMNS), "csv", sep="\t")


def read_deep_survey(spark: SparkSession, path) -> DataFrame:
    """Deep survey, comma-separated."""
    return read_table(spark, path, doubles(DEEP_SURVEY_COLUMNS), "csv")


def read_tiles(spark: SparkSession, path, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Every tile file of a directory as one table; ``tile`` is the file's name unless stored."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("delimited text needs a schema")
        df = read_delimited(spark, [path] if isinstance(path, str) else list(path), schema).withColumnRenamed("_file", "_tile")
    else:
        reader = spark.read.format(fmt)
        df = (reader if schema is None else reader.schema(schema)).load(path)
        df = df if "tile" in df.columns else df.withColumn("_tile", F.col("_metadata.file_name"))
    df = df.drop("_tile") if "tile" in df.columns else df.withColumnRenamed("_tile", "tile")
    return nan_to_null(df)


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, aligned by name; absent columns are NULL."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole


def as_table(spark: SparkSession, table: DataFrame | None = None, path: str | None = None, **options) -> DataFrame:
    """A given table, else the one at ``path``."""
    if path is not None:
        return read_table(spark, path, **options)
    if table is None:
        raise ValueError("either a table or a path is needed")
    return table


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", sep: str = ",") -> None:
    """Write a catalogue, replacing an older one."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("sep", sep)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def join_weights(df: DataFrame, weights: DataFrame, key: Sequence[str], column: str = "weight") -> DataFrame:
    """Stored weights as a column; every row needs one to take part in a weighted fit."""
    return df.join(weights.select(*key, column), list(key), "left")
