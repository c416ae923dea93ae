"""Equal-width histograms in one and two dimensions.

Ranges found in the data are one-row scalar subqueries, so a histogram is one lazy plan: a
column-pruned scan for the range and one for the counts, with partial aggregation per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.functions.sky import present


def column_range(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum and count of a column, one row."""
    c = F.col(column)
    value = F.when(present(c), c)
    return df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))


def _scalar(row: DataFrame) -> Column:
    return row.select(F.struct(*row.columns)).scalar()


def bin_of(value: Column, lo: Column, step: Column, bins: Column) -> Column:
    """Bin closed on the left; the last bin also holds the upper end."""
    spot = F.floor((value - lo) / F.nullif(step, F.lit(0.0)))
    return F.greatest(F.lit(0), F.least(F.coalesce(spot, F.lit(0)), bins - 1)).cast("bigint")


def _edges(df: DataFrame, column: str, bins: int, range_: tuple[float, float] | None):
    if range_ is not None:
        lo, hi = F.lit(float(range_[0])), F.lit(float(range_[1]))
    else:
        ends = _scalar(column_range(df, column).select("lo", "hi"))
        # a single value gets a range of one unit around it
        flat = ends.getField("lo") == ends.getField("hi")
        lo = F.when(flat, ends.getField("lo") - 0.5).otherwise(ends.getField("lo"))
        hi = F.when(flat, ends.getField("hi") + 0.5).otherwise(ends.getField("hi"))
    return lo, hi, (hi - lo) / F.lit(float(bins))


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    range_: tuple[float, float] | None = None,
    density: bool = False,
) -> DataFrame:
    """``(bin, lower, upper, cnt[, density])`` for every bin, empty ones included.

    Values outside a given range are not counted.
    """
    values = df.filter(present(F.col(column))).select(F.col(column).cast("double").alias("_v"))
    lo, hi, step = _edges(values, "_v", bins, range_)
    if range_ is not None:
        values = values.filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
    counted = values.groupBy(bin_of(F.col("_v"), lo, step, F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    table = every.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * step).alias("lower"),
        (lo + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
    )
    if density:
        total = values.agg(F.count(F.lit(1)).alias("n")).scalar()
        table = table.withColumn("density", F.col("cnt") / F.nullif(total * step, F.lit(0.0)))
    return table


def histogram2d(
    df: DataFrame,
    x: str,
    y: str,
    bins: tuple[int, int] = (50, 50),
    ranges: tuple[tuple[float, float] | None, tuple[float, float] | None] = (None, None),
) -> DataFrame:
    """Counts of the occupied cells ``(bx, by, cnt)``; rows missing either value are left out."""
    values = df.filter(present(F.col(x)) & present(F.col(y))).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    keys = []
    for name, alias, n, range_ in (("_x", "bx", bins[0], ranges[0]), ("_y", "by", bins[1], ranges[1])):
        lo, hi, step = _edges(values, name, n, range_)
        if range_ is not None:
            values = values.filter((F.col(name) >= lo) & (F.col(name) <= hi))
        keys.append(bin_of(F.col(name), lo, step, F.lit(n)).alias(alias))
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
