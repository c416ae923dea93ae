"""Image cut-outs as nested array columns that travel with their object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.operators import pixel_stats

# Fixed value: one over the upper quartile of the standard normal distribution.
MAD_TO_STD = 1.482602218505602


def as_image(flat: Column, width: int) -> Column:
    """Flat pixel array as rows of ``width`` pixels."""
    rows = F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1)
    return F.transform(rows, lambda i: F.slice(flat, i * width + 1, width))


def mask_bad(image: Column) -> Column:
    """Pixels at or below -1, and NaN, become 0."""
    def good(p):
        return F.when((p > -1) & ~F.isnan(p), p).otherwise(F.lit(0.0).cast("float"))
    return F.transform(image, lambda row: F.transform(row, good))


def stack_bands(images: Sequence[Column]) -> Column:
    """Equal-sized band images as one ``[row][column][band]`` array."""
    first, others = images[0], images[1:]

    def pixel(i):
        return lambda p, j: F.array(p, *[F.get(F.get(o, i), j) for o in others])
    return F.transform(first, lambda row, i: F.transform(row, pixel(i)))


def pixel_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Robust standard deviation over all pixels of each image column.

    No row per pixel is made; see :mod:`skylattice.operators.pixel_stats`.
    """
    middle = pixel_stats.pixel_medians(df, columns)
    known = {c: m for c, m in middle.items() if m is not None}
    away = pixel_stats.pixel_medians(df, list(known), known) if known else {}
    return {c: away[c] * MAD_TO_STD if c in away else None for c in columns}


def arcsinh_stretch(image: Column, scale: float) -> Column:
    return F.transform(image, lambda row: F.transform(row, lambda p: F.asinh(p.cast("double") / F.lit(scale))))


def prepare_images(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Stretched images of the train part and of the other parts, with the train part's scales."""
    scales = pixel_scales(train, columns)
    unusable = [c for c in columns if not scales[c]]
    if unusable:
        raise ValueError(f"no pixel spread in {unusable}")
    stretched = {c: arcsinh_stretch(F.col(c), scales[c]) for c in columns}
    return [d.withColumns(stretched) for d in (train, *others)]
