"""Projections: sentinels to NULL, zero points, wide and short names, colours."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from skylattice.config import SurveyConfig
from skylattice.functions.names import band_orders, object_name

# Short names of the training tables.
MAGNITUDES = {"MAG_AUTO_R": "r", "MAG_AUTO_U": "u", "MAG_AUTO_I": "i", "MAG_AUTO_Z": "z"}
THREE_SURVEY_MAGNITUDES = {
    "MAG_AUTO_R": "r", "MAG_u": "u", "i_stk_aper": "i", "z_stk_aper": "z", "g_stk_aper": "g",
}
MORPHOLOGY = {
    "gal_sb": "Surf. bright.", "gal_rho4": "Rho4", "gal_sigma": "Galaxy size",
    "gal_gini": "Gini index", "ELONGATION": "Elongation",
}
TARGET = {"Z_SPEC": "Z spec"}
WEIGHT_NAMES = {
    "MAG_AUTO_R": "r", "MAG_AUTO_I": "i", "i_stk_aper": "i", "MAG_AUTO_Z": "z",
    "z_stk_aper": "z", "g_stk_aper": "g", "MAG_AUTO_U": "u", "MAG_u": "u",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def values_to_null(df: DataFrame, values: Sequence[float], columns: Iterable[str] | None = None) -> DataFrame:
    """NULL in place of each sentinel value and of NaN; all numeric columns unless named."""
    changed = {}
    for name in columns if columns is not None else numeric_columns(df):
        c = F.col(f"`{name}`")
        changed[name] = F.when(~(c.isin(*values) | F.isnan(c)), c)
    return df.withColumns(changed)


def external_sentinels(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """-99, 99 and 0 mean "no value" in the external survey table."""
    return values_to_null(df, (-99, 99, 0), columns)


def training_sentinels(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """-1, -10 and -99 mean "no value" in a training table."""
    return values_to_null(df, (-1, -10, -99), columns)


def magnitude_sentinels(df: DataFrame, cfg: SurveyConfig, params: Sequence[str] = ("MAG_AUTO", "MAG_WIN")) -> DataFrame:
    """Magnitudes above the sentinel become NULL in every band but the first."""
    changed = {}
    for p in params:
        for b in cfg.bands[1:]:
            c = F.col(f"{p}_{b}")
            changed[f"{p}_{b}"] = F.when(~F.isnan(c) & (c <= cfg.mag_sentinel_above), c)
    return df.withColumns(changed) if changed else df


def zero_point(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Shift ``MAG_AUTO`` of every band but the first, if the survey asks for it."""
    if not cfg.zero_point_shift or len(cfg.bands) < 2:
        return df
    names = [f"MAG_AUTO_{b}" for b in cfg.bands[1:]]
    return df.withColumns({n: F.col(n) + F.lit(cfg.zero_point_shift) for n in names})


def shear(df: DataFrame) -> DataFrame:
    """``gal_g = |gal_g1 + gal_g2|`` in place of its two parts."""
    return df.withColumn("gal_g", F.abs(F.col("gal_g1") + F.col("gal_g2"))).drop("gal_g1", "gal_g2")


def assemble_bands(
    bands: Mapping[str, DataFrame], params: Sequence[str], carry: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """Band tables side by side as ``PARAM_BAND``, aligned on (``tile``, ``ide``).

    ``carry[band]`` maps further source columns of a band to output names. A tile that lacks a
    band has no row in that band's table and so drops out of the inner join. All joins use the
    same key, so each table is exchanged once.
    """
    wide = None
    for band, table in bands.items():
        columns = [F.col(p).alias(f"{p}_{band}") for p in params if p in table.columns]
        if len(columns) < len(params) and params:
            missing = sorted(set(params) - set(table.columns))
            raise ValueError(f"band {band} lacks the columns {missing}")
        extra = [F.col(s).alias(t) for s, t in carry.get(band, {}).items()]
        part = table.select("tile", "ide", *columns, *extra)
        wide = part if wide is None else wide.join(part, ["tile", "ide"])
    return wide


def with_object_name(df: DataFrame) -> DataFrame:
    return df.withColumn("NAME", object_name(F.col("tile"), F.col("ide")))


def short_names(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Selected columns under their short names; ``keep`` columns stay in front."""
    return df.select(*keep, *[F.col(s).alias(t) for s, t in mapping.items()])


def rename_unmatched(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return short_names(df, MAGNITUDES, keep)


def rename_matched(df: DataFrame, morphology: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    return short_names(df, {**MAGNITUDES, **(MORPHOLOGY if morphology else {}), **TARGET}, keep)


def rename_for_weights(df: DataFrame) -> DataFrame:
    """Short band names; names that are absent are ignored."""
    present = {s: t for s, t in WEIGHT_NAMES.items() if s in df.columns}
    return df.withColumnsRenamed(present)


def colours(df: DataFrame, bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Differences of neighbours in ``order``, placed after the first band.

    Colours are taken by name, so ``g-r`` is g minus r. The first band stays, the other
    magnitudes go.
    """
    unknown = set(order) ^ set(bands)
    if unknown:
        raise ValueError(f"order and bands differ in {sorted(unknown)}")
    first, dropped = bands[0], set(bands[1:])
    pairs = [(F.col(a) - F.col(b)).alias(f"{a}-{b}") for a, b in zip(order, order[1:])]
    columns = []
    for name in df.columns:
        if name in dropped:
            continue
        columns.append(F.col(f"`{name}`"))
        if name == first:
            columns += pairs
    return df.select(*columns)


def colour_variants(df: DataFrame, bands: Sequence[str]) -> list[DataFrame]:
    """The table itself and one lazy colour table per order of the bands."""
    return [df] + [colours(df, bands, order) for order in band_orders(bands)]
