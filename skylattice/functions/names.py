"""Names, labels and letters."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, functions as F


def object_name(tile_file: Column, row: Column) -> Column:
    """Name of an object: the tile's file name without its first four and last five characters,
    an underscore, the row number."""
    stem = F.substring(tile_file, F.lit(5), F.greatest(F.length(tile_file) - 9, F.lit(0)))
    return F.concat_ws("_", stem, row.cast("string"))


def uncommon_letters(a: Column, b: Column) -> Column:
    """Letters that occur in exactly one of two strings, in order, as an array."""
    left, right = F.split(a, ""), F.split(b, "")
    either = F.concat(F.array_except(left, right), F.array_except(right, left))
    return F.array_sort(F.filter(either, lambda c: c != F.lit("")))


def with_error(value: Column, error: Column) -> Column:
    """Report text ``x.xxx+-y.yyy``."""
    return F.format_string("%.3f+-%.3f", value, error)


def band_orders(bands) -> list[tuple[str, ...]]:
    """All orders of the bands."""
    return list(permutations(bands))


def band_subsets(bands) -> list[tuple[str, ...]]:
    """All proper non-empty subsets, smaller ones first."""
    return [s for size in range(1, len(bands)) for s in combinations(bands, size)]
