"""Weights that make a training table look like the full population.

The weight of an object is the population density at its magnitude divided by the training
density. Both histograms have one bin per ten training rows, so the bin tables grow with the
data: they are joined on the bin number and Spark chooses the strategy from their real size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators.histogram import bin_of, column_range


def band_weights(
    train: DataFrame, population: DataFrame, key: Sequence[str], column: str, alias: str = "weight"
) -> DataFrame:
    """``key`` and weight of every training row, from one band.

    Counting bins are closed on the left, a value looks itself up in bins closed on the right.
    Outside the population's range the weight is 0; where the training density is 0, or the value
    is missing, it is NULL.
    """
    return _weights(train, population, list(key), [column]).select(
        *key, F.col("_weight").alias(alias)
    )


def mean_weights(
    train: DataFrame, population: DataFrame, key: Sequence[str], columns: Sequence[str], alias: str = "weight"
) -> DataFrame:
    """Mean of the band weights; NULL where any of them is NULL.

    The bands are stacked, so all of them share one pass of joins.
    """
    stacked = _weights(train, population, list(key), list(columns))
    return stacked.groupBy(*key).agg(
        F.when(F.count("_weight") == len(columns), F.avg("_weight")).alias(alias)
    )


def _stack(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("_band"), F.col(c).cast("double").alias("_v")) for c in columns]
    return df.select(*key, F.inline(F.array(*pairs)))


def _density(df: DataFrame, columns: list[str], bins: Column, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Range table and density table per band of one side."""
    stacked = _stack(df, [], columns).filter(present(F.col("_v")))
    ranges = stacked.groupBy("_band").agg(
        F.min("_v").alias(f"_{prefix}lo"), F.max("_v").alias(f"_{prefix}hi"), F.count("_v").alias("_total")
    )
    lo, hi = F.col(f"_{prefix}lo"), F.col(f"_{prefix}hi")
    step = (hi - lo) / bins
    # one row per band: bounded by the number of bands
    counted = (
        stacked.join(F.broadcast(ranges), "_band")
        .groupBy("_band", bin_of(F.col("_v"), lo, step, bins).alias(f"_{prefix}bin"))
        .agg(
            (F.count(F.lit(1)) / F.nullif(F.first("_total") * F.first(step), F.lit(0.0))).alias(
                f"_{prefix}density"
            )
        )
    )
    return ranges.drop("_total"), counted


def _weights(train: DataFrame, population: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    bins = F.floor(train.agg(F.count(F.lit(1)).alias("n")).scalar() / 10)
    checked = F.when(bins >= 1, bins).otherwise(
        F.raise_error(F.lit("weights need at least ten training rows")).cast("bigint")
    )
    train_range, train_density = _density(train, columns, checked, "t")
    pop_range, pop_density = _density(population, columns, checked, "p")
    v = F.col("_v")

    def lookup(prefix: str) -> Column:
        lo, hi = F.col(f"_{prefix}lo"), F.col(f"_{prefix}hi")
        step = (hi - lo) / checked
        spot = F.ceil((v - lo) / F.nullif(step, F.lit(0.0))) - 1
        return F.least(checked - 1, F.greatest(F.lit(0), F.coalesce(spot, F.lit(0)))).cast("bigint")

    ranged = (
        _stack(train, key, columns)
        .join(F.broadcast(train_range), "_band", "left")
        .join(F.broadcast(pop_range), "_band", "left")
    )
    # a missing value, or one of a flat range, has no density: such rows would all meet in one bin
    weighed = present(v) & (F.col("_thi") > F.col("_tlo"))
    placed = ranged.filter(weighed).withColumns({"_tbin": lookup("t"), "_pbin": lookup("p")})
    joined = placed.join(train_density, ["_band", "_tbin"], "left").join(
        pop_density, ["_band", "_pbin"], "left"
    )
    inside = (v >= F.col("_plo")) & (v <= F.col("_phi"))
    above = F.when(inside, F.coalesce("_pdensity", F.lit(0.0))).otherwise(F.lit(0.0))
    weight = above / F.nullif(F.col("_tdensity"), F.lit(0.0))
    without = ranged.filter(~F.coalesce(weighed, F.lit(False))).select(*key, "_band", F.lit(None).cast("double").alias("_weight"))
    return joined.select(*key, "_band", weight.alias("_weight")).unionByName(without)
