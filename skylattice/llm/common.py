"""What several operators share: reading a table, Arrow batches, staged tables, union-find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.session import shared_folder, staged, staging

__all__ = ["components", "read", "shared_folder", "small_batches", "staged", "staging"]

#: Rows of one Arrow batch. Whole texts travel in a batch, so a worker holds this many of them.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch, for tables of very long texts.
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node points at one root, and no root points on."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    bad = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bad.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (u, v)``: one row ``(node, root)`` per node, root the least node.

    Distributed union-find by alternating large and small stars. Each round is a grouped minimum, which
    is summed before the exchange, and a join that adaptive execution may split at a hot node; its edges
    are written to the shared folder, so the lineage stays short and a lost executor costs a re-read.
    Self links, repeated links and nulls are allowed; an empty table gives an empty table.
    """
    with staging(edges.sparkSession) as stage:
        now = staged(_stars(edges, stage))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges from each node to the least node of its component."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = stage(edges.where("u != v").select(high.alias("u"), low.alias("v")).distinct())
    while not now.isEmpty() and not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").where("u != v").distinct())
    return now
