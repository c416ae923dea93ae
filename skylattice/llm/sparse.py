"""Rows of sparse features as numpy arrays, gathered from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


#: Entries worked on at once, which bounds the memory beside the rows themselves.
BLOCK = 1 << 20


@dataclass
class Sparse:
    """Features of rows end to end: ``index`` and ``value`` of row i lie from ``start[i]`` to ``start[i + 1]``."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> "Sparse":
        start = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        if not rows:
            return cls(np.empty(0, np.int64), np.empty(0, np.float32), start)
        return cls(np.concatenate([i for i, _ in rows]).astype(np.int32),
                   np.concatenate([v for _, v in rows]).astype(np.float32), start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def _blocks(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """Runs of rows of about BLOCK entries: first and last row, their entries, and the row of each entry within the run."""
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.start, self.start[at] + BLOCK, "right")) - 1)
            yield at, upto, slice(self.start[at], self.start[upto]), np.repeat(np.arange(upto - at), np.diff(self.start[at:upto + 1]))
            at = upto

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """One value, or one row of values, for each row."""
        if weights.ndim == 1:
            out = np.zeros(len(self))
            for a, b, part, row in self._blocks():
                out[a:b] = np.bincount(row, weights[self.index[part]] * self.value[part], b - a)
            return out
        return np.stack([self.dot(weights[:, k]) for k in range(weights.shape[1])], axis=1)

    def transposed_dot(self, values: np.ndarray, size: int) -> np.ndarray:
        """Sum over rows of value times features."""
        if values.ndim == 1:
            out = np.zeros(size)
            for a, b, part, row in self._blocks():
                out += np.bincount(self.index[part], values[a:b][row] * self.value[part], size)
            return out
        return np.stack([self.transposed_dot(values[:, k], size) for k in range(values.shape[1])], axis=1)

    def take(self, rows: np.ndarray) -> "Sparse":
        length = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        out = Sparse(np.empty(start[-1], self.index.dtype), np.empty(start[-1], self.value.dtype), start)
        for a, b, part, row in out._blocks():
            at = np.arange(part.start, part.stop) + (self.start[rows[a:b]] - start[a:b])[row]
            out.index[part], out.value[part] = self.index[at], self.value[at]
        return out


def fold_of(key: str, folds: int) -> Column:
    """Remainder of the checksum of the key as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def bounded_ids(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` of the keys (all, if there are fewer), the same ones on every run."""
    n = rows.count()
    if n <= most:
        return rows.select(key)
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1_000_003)) < int(1_000_003 * most / n)).select(key)
