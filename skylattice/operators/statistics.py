"""Whole-table statistics: correlations, missing values, per-tile summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators.project import numeric_columns


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations as ``(a, b, corr)``; each pair uses the rows where both are present.

    One aggregation for all pairs; the matrix is symmetric, so each pair is computed once.
    """
    columns = list(columns) if columns else numeric_columns(df)
    clean = df.select(*[F.when(present(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = clean.agg(*[F.corr(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        for a, b in {(i, j), (j, i)}:
            cells.append(F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), F.col(f"r_{i}_{j}").alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def missing_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing_percent)`` of every column, in one aggregation."""
    columns = list(columns) if columns else df.columns
    kinds = dict(df.dtypes)
    ratios = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        gone = col.isNull() | F.isnan(col) if kinds[c] in ("double", "float") else col.isNull()
        ratios.append((F.avg(F.when(gone, 1.0).otherwise(0.0)) * 100).alias(f"m{i}"))
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_percent"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*ratios).select(F.inline(F.array(*cells)))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None, top: int = 30) -> DataFrame:
    """Columns with missing values, worst first, at most ``top`` of them."""
    shares = missing_shares(df, columns).filter(F.col("missing_percent") > 0)
    return shares.orderBy(F.desc("missing_percent"), "column").limit(top)


def tile_statistics(df: DataFrame, magnitude: str = "MAG_AUTO_R", redshift: str = "Z_SPEC") -> DataFrame:
    """Per tile: rows, matched rows and the correlation of magnitude with redshift."""
    return df.groupBy("tile").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(present(F.col(redshift)), 1)).alias("matched"),
        F.corr(magnitude, redshift).alias("corr_mag_z"),
    )
