"""Feature columns and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

FEATURES = "features"


def assemble(columns: Sequence[str], output: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def feature_columns(df: DataFrame, target: str, keep: Sequence[str] = ()) -> list[str]:
    """Everything but the target and the bookkeeping columns, in table order."""
    return [c for c in df.columns if c != target and c not in set(keep)]
