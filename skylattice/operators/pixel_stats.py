"""Exact order statistics over the pixels of image columns, without a row per pixel.

A number is read as its 64 bits in an order that agrees with its size. Each of four passes fixes 16 bits more
of the wanted values: a task counts, batch by batch of whole images, how many pixels share the bits fixed so far
and how they split by the next ones, and sends one row per split. So what is exchanged follows the tasks, not the pixels, and
the driver sees at most 65536 counts per column and wanted rank. All columns share a pass. NULL and NaN are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType

STEP, WORD = 16, 64
SIGN = np.uint64(1 << 63)
COUNTS = "column int, fixed long, next int, n long"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def from_bits(bits: int) -> float:
    """The double of :func:`ordered_bits`."""
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.uint64(raw).view(np.float64))


def pixel_medians(df: DataFrame, columns: Sequence[str], around: Mapping[str, float] | None = None) -> dict[str, float | None]:
    """Median over all pixels of each image column (arrays of any depth), None without a pixel.

    With ``around`` the median distance from a value per column.
    """
    columns = list(columns)
    images = df.select(*[_flat(df.schema[c].dataType, c).alias(f"c{i}") for i, c in enumerate(columns)])
    centre = [None if around is None else around[c] for c in columns]
    tops = _counted(images, centre, {i: {0} for i in range(len(columns))}, 0)
    #: Per column and wanted rank: the bits fixed so far and the rank among the pixels that share them.
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(columns)):
        if n := sum(tops.get((i, 0), {}).values()):
            wanted[i] = [(0, r) for r in sorted({(n - 1) // 2, n // 2})]
    for done in range(0, WORD, STEP):
        if not wanted:
            break
        counts = tops if done == 0 else _counted(images, centre, {i: {f for f, _ in ranks} for i, ranks in wanted.items()}, done)
        wanted = {i: [_descend(counts[i, f], f, r) for f, r in ranks] for i, ranks in wanted.items()}
    middle = {i: [from_bits(f) for f, _ in ranks] for i, ranks in wanted.items()}
    return {c: sum(middle[i]) / len(middle[i]) if i in middle else None for i, c in enumerate(columns)}


def _descend(split: Mapping[int, int], fixed: int, rank: int) -> tuple[int, int]:
    for part in sorted(split):
        if rank < split[part]:
            return fixed << STEP | part, rank
        rank -= split[part]
    raise AssertionError("counts of two passes differ")


def _flat(kind: DataType, column: str):
    """All pixels of an image as one array; a missing row of an image has none."""
    c, depth = F.col(f"`{column}`"), 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    for level in range(depth - 1):
        c = F.flatten(F.filter(c, lambda part: part.isNotNull()))
    return c.cast("array<double>") if depth else F.array(c.cast("double"))


def _counted(images: DataFrame, centre: Sequence[float | None], fixed: Mapping[int, set[int]], done: int) -> dict[tuple[int, int], dict[int, int]]:
    """Counts by the next bits, of the pixels whose first ``done`` bits are among ``fixed``."""
    prefixes = {i: sorted(f) for i, f in fixed.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, f): np.zeros(1 << STEP, np.int64) for i, fs in prefixes.items() for f in fs}
        for batch in batches:
            for i, fs in prefixes.items():
                pixels = batch.column(i).flatten().drop_null().to_numpy(zero_copy_only=False)
                if centre[i] is not None:
                    pixels = np.abs(pixels - centre[i])
                bits = ordered_bits(pixels[~np.isnan(pixels)])
                following = (bits >> np.uint64(WORD - STEP - done)) & np.uint64((1 << STEP) - 1)
                for f in fs:
                    # a shift by the whole word is not defined
                    mine = following[bits >> np.uint64(WORD - done) == np.uint64(f)] if done else following
                    total[i, f] += np.bincount(mine.astype(np.int64), minlength=1 << STEP)
        for (i, f), counts in total.items():
            parts = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(parts), i, np.int32)), pa.array(np.full(len(parts), f, np.int64)),
                 pa.array(parts.astype(np.int32)), pa.array(counts[parts])], names=["column", "fixed", "next", "n"])

    rows = images.mapInArrow(partial, COUNTS).groupBy("column", "fixed", "next").agg(F.sum("n").alias("n")).collect()
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        found.setdefault((r["column"], r["fixed"]), {})[r["next"]] = r["n"]
    return found
