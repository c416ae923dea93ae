"""Folds, hold-out parts and column shuffles by arithmetic on the row key.

A mixed key spreads rows evenly, needs no sort and no row positions, and gives the same
parts on every run, partitioning and engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from skylattice.operators import order_stats

# A prime above any 31-bit key, and the multipliers of the mixing step.
MODULUS = 2147483647
MULTIPLIER = 1103515245
SEED_STEP = 12345


def mixed_key(df: DataFrame, key: Sequence[str], seed: int = 0) -> Column:
    """Number in [0, MODULUS) that scatters the key; distinct for integer keys below MODULUS.

    A linear step brings in the seed, the fifth power breaks the line: it maps the residues onto
    themselves one to one, and different seeds give unrelated orders.
    """
    key = list(key)
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, IntegralType):
        base = F.pmod(F.col(key[0]).cast("bigint"), F.lit(MODULUS))
    else:
        base = F.pmod(F.xxhash64(*key), F.lit(MODULUS))
    x = (base * F.lit(MULTIPLIER) + F.lit(seed * SEED_STEP + 1)) % F.lit(MODULUS)
    square = (x * x) % F.lit(MODULUS)
    return (((square * square) % F.lit(MODULUS)) * x) % F.lit(MODULUS)


def _slot(mixed: Column, slots: int) -> Column:
    return F.floor(mixed * F.lit(slots) / F.lit(float(MODULUS))).cast("int")


def _slots_by_rank(df: DataFrame, value: Column, k: int, tie: Column | None = None) -> Column:
    """Slots of exactly ``floor(n/k)`` rows in order of ``value``; the last takes the rest.

    Rows of one value are parted by ``tie``; without it they stay together.
    """
    keys = df.select(value.alias("_v"), (F.lit(0) if tie is None else tie).cast("bigint").alias("_t"))
    n = order_stats.present_counts(keys, ["_v"])["_v"]
    size = n // k
    if size == 0:
        raise ValueError(f"{n} rows cannot fill {k} folds")
    ranks = [i * size for i in range(1, k)]
    starts = order_stats.order_statistics(keys, {"_v": ranks})["_v"] if ranks else []
    first = [None] * len(starts)
    if tie is not None and starts:
        v = F.col("_v")
        found = keys.agg(*[f.alias(f"{c}{i}") for i, s in enumerate(starts) for c, f in (
            ("below", F.count_if(v < F.lit(s))), ("equal", F.count_if(v == F.lit(s))))]).first()
        for i, s in enumerate(starts):
            if found[f"equal{i}"] > 1:
                tied = keys.where(v == F.lit(s))
                first[i] = order_stats.order_statistics(tied, {"_t": [ranks[i] - found[f"below{i}"]]})["_t"][0]
    slot = F.lit(0)
    for s, t in zip(starts, first):
        beyond = value >= F.lit(s) if t is None else (value > F.lit(s)) | ((value == F.lit(s)) & (tie >= F.lit(t)))
        slot = slot + F.when(beyond, 1).otherwise(0)
    return slot.cast("int")


def shuffled_folds(df: DataFrame, key: Sequence[str], k: int, seed: int = 0, exact: bool = False) -> DataFrame:
    """``fold`` in 0..k-1 in an order scattered by the key; ``exact`` asks for equal sizes.

    Keys that fall on one mixed number are put in the order of a 64-bit hash, so sizes are exact for
    long, composite and text keys too.
    """
    mixed = mixed_key(df, key, seed)
    return df.withColumn("fold", _slots_by_rank(df, mixed, k, F.xxhash64(*key)) if exact else _slot(mixed, k))


def contiguous_folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """``fold`` by unshuffled blocks of ``floor(n/k)`` rows in the order of a numeric column."""
    return df.withColumn("fold", _slots_by_rank(df, F.col(order), k))


def holdout(
    df: DataFrame, key: Sequence[str], share: float = 0.2, seed: int = 0, validation: bool = False
) -> DataFrame:
    """``part`` = test for about ``share`` of the rows, else train; with ``validation`` the same
    share of the train rows becomes validation."""
    limit = F.lit(int(share * MODULUS))
    part = F.when(mixed_key(df, key, seed) < limit, "test")
    if validation:
        part = part.when(mixed_key(df, key, seed + 1) < limit, "validation")
    return df.withColumn("part", part.otherwise("train"))


def shuffle_columns(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], names: Sequence[str], seed: int = 0,
    group_rows: int = 100_000, rows: int | None = None,
) -> DataFrame:
    """The table with a permuted copy of each of ``columns`` under ``names``.

    Rows fall into groups of about ``group_rows`` by their mixed key; within a group every row
    takes the value of the next row in a second scattered order, the last one the first's. The
    key is unique, so no group grows with the data. All columns share one window.
    """
    n = df.count() if rows is None else rows
    groups = max(1, math.ceil(n / group_rows))
    window = Window.partitionBy("_group").orderBy("_turn", *key)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = df.withColumns({
        "_group": _slot(mixed_key(df, key, seed), groups),
        "_turn": mixed_key(df, key, seed + 7919),
    }).withColumn("_last", F.lead(F.lit(1)).over(window).isNull())
    copies = [
        F.when(F.col("_last"), F.first(f"`{c}`").over(whole)).otherwise(F.lead(f"`{c}`").over(window)).alias(n)
        for c, n in zip(columns, names)]
    return moved.select(*[F.col(f"`{c}`") for c in df.columns], *copies)


def shuffle_column(
    df: DataFrame, key: Sequence[str], column: str, seed: int = 0, group_rows: int = 100_000,
    rows: int | None = None,
) -> DataFrame:
    """The table with one column permuted, all others in place."""
    moved = shuffle_columns(df, key, [column], ["_moved"], seed, group_rows, rows)
    return moved.select(*[F.col("_moved").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
