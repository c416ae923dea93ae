"""Feature scaling by column arithmetic, with exact statistics of the fitted table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skylattice.functions.sky import present
from skylattice.operators import order_stats

KINDS = ("standard", "robust")


@dataclass(frozen=True)
class Scaling:
    centre: dict[str, float]
    spread: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(f"`{c}`") - F.lit(self.centre[c])) / F.lit(self.spread[c]) for c in self.centre
        })


def fit(df: DataFrame, columns: Sequence[str], kind: str) -> Scaling:
    """``standard``: mean and population deviation; ``robust``: median and quartile distance.

    A column without spread is centred only.
    """
    if kind == "standard":
        centre, spread = _standard(df, columns)
    elif kind == "robust":
        centre, spread = _robust(df, columns)
    else:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    return Scaling(centre, {c: s if s else 1.0 for c, s in spread.items()})


def _standard(df, columns):
    sums = []
    for i, c in enumerate(columns):
        value = F.when(present(F.col(f"`{c}`")), F.col(f"`{c}`"))
        sums += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = df.agg(*sums).first()
    return ({c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
            {c: row[f"s{i}"] for i, c in enumerate(columns)})


def _robust(df, columns):
    counts = order_stats.present_counts(df, columns)
    spots = {c: [share * (counts[c] - 1) for share in (0.25, 0.5, 0.75)] for c in columns if counts[c]}
    ranks = {c: sorted({r for s in at for r in (math.floor(s), math.ceil(s))}) for c, at in spots.items()}
    found = order_stats.order_statistics(df, ranks)
    centre, spread = {c: 0.0 for c in columns}, {c: None for c in columns}
    for c, at in spots.items():
        value = dict(zip(ranks[c], found[c]))
        low, middle, high = (
            value[math.floor(s)] + (value[math.ceil(s)] - value[math.floor(s)]) * (s - math.floor(s)) for s in at
        )
        centre[c], spread[c] = middle, high - low
    return centre, spread
