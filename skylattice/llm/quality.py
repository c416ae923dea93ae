"""Quality classifier: learning from positive and unlabelled texts.

A linear model on hashed words and on binned figures of a text's form minimises the non-negative unbiased
risk: with class prior p, trusted positives P and unlabelled web text U,
``p * R(P, +) + max(0, R(U, -) - p * R(P, -))`` under the logistic loss; where the bracket is negative its
gradient is reversed, as the non-negative estimator asks. The prior is estimated as the share of positives
among the labelled texts of the learning folds. A two-parameter logistic curve fitted to labelled texts of
those folds that took no part in the risk turns margins into probabilities.

Learning uses a bounded sample (``Sample``), picked by a hash of the id; every text is scored whole.

Defined results: a null id has no fold, is never learnt from and is scored; a null text scores as an empty one; empty texts have no words and one bin for each figure;
an empty table gives an empty table; without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.common import small_batches
from skylattice.llm.sparse import Sparse, bounded_ids, fold_of
from skylattice.llm.text import WordHashes

WORD_BUCKETS = 1 << 13
BINS = 24
FIGURES = 11
SIZE = WORD_BUCKETS + FIGURES * BINS
#: Features are numbered in so many bytes.
_INDEX = np.uint16
#: Share of a text's squared length that its words have.
_WORD_SHARE = 0.5

_SYMBOL, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _HIGH = range(7)
_CLASS = np.full(256, 7, np.uint8)
for _c in range(256):
    ch = chr(_c)
    if _c >= 0x80:
        _CLASS[_c] = _HIGH
    elif ch in ".,;:":
        _CLASS[_c] = _STOP
    elif ch == "\n":
        _CLASS[_c] = _LINE
    elif ch.isspace() or _c < 32:
        _CLASS[_c] = _SPACE
    elif ch.isdigit():
        _CLASS[_c] = _DIGIT
    elif ch.isupper():
        _CLASS[_c] = _UPPER
    elif not ch.islower():
        _CLASS[_c] = _SYMBOL


@dataclass(frozen=True)
class Sample:
    """Most texts that learning gathers: trusted positives, unlabelled, and labelled ones for the curve."""

    positives: int = 6000
    unlabelled: int = 10000
    curve: int = 4000


def _bin(x: float) -> int:
    """Finer near nought: the square root of a share, in BINS steps."""
    return min(BINS - 1, int(max(0.0, x) ** 0.5 * BINS))


def features(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a whole text and bins of its form."""
    text = text or b""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / chars
    if n:
        h = np.fromiter((hashes[w] for w in words), np.uint64, n)
        kinds, times = np.unique(h, return_counts=True)
        bucket = np.bincount((kinds % np.uint64(WORD_BUCKETS)).astype(np.int64), np.log1p(times))
        index = np.flatnonzero(bucket)
        value = bucket[index]
        value = value * (_WORD_SHARE ** 0.5 / np.linalg.norm(value))
        unique, top, again = len(kinds) / n, times.max() / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    else:
        index, value, unique, top, again = np.empty(0, np.int64), np.empty(0), 0.0, 0.0, 0.0
    lines = text.split(b"\n")
    # A text of few words has few different ones anyway: what is left of the expected number.
    shares = (counts[_SYMBOL], counts[_UPPER], counts[_DIGIT], counts[_LINE], counts[_STOP], counts[_HIGH],
              unique, top, again, min(1.0, chars / max(1, n) / 24), len(set(lines)) / len(lines))
    bins = WORD_BUCKETS + np.arange(FIGURES) * BINS + np.array([_bin(float(s)) for s in shares])
    return np.concatenate([index, bins]), np.concatenate([value, np.full(FIGURES, ((1 - _WORD_SHARE) / FIGURES) ** 0.5)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def score(self, rows: Sparse) -> np.ndarray:
        return _sigmoid(self.slope * (rows.dot(self.weights) + self.bias) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def learn(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 150, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Minimise the non-negative unbiased risk by full-batch steps with running moments."""
    theta, m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    if not len(positive) or not len(unlabelled):
        return Model(theta[:-1], 0.0, prior=prior)
    for step in range(1, steps + 1):
        gp, gu = (x.dot(theta[:-1]) + theta[-1] for x in (positive, unlabelled))
        below = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # d log(1 + exp(g)) = sigmoid(g); d log(1 + exp(-g)) = sigmoid(g) - 1.
        down_u, down_p = _sigmoid(gu) / len(gu), -prior * _sigmoid(gp) / len(gp)
        up_p = prior * (_sigmoid(gp) - 1) / len(gp)
        du, dp = (down_u, down_p + up_p) if below >= 0 else (-down_u, -down_p)
        grad = np.append(positive.transposed_dot(dp, SIZE) + unlabelled.transposed_dot(du, SIZE), dp.sum() + du.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:-1], float(theta[-1]), prior=prior)


def calibrate(model: Model, rows: Sparse, labels: np.ndarray) -> Model:
    """Fit the curve from margins to probabilities by Newton steps, with a weak pull to slope one."""
    if len(rows) and 0 < labels.sum() < len(labels):
        g = rows.dot(model.weights) + model.bias
        g, scale = g / (g.std() or 1.0), g.std() or 1.0
        x, t = np.stack([g, np.ones_like(g)], axis=1), np.zeros(2)
        for _ in range(50):
            p = _sigmoid(x @ t)
            hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * len(g) * np.eye(2) * [1, 0.01]
            t = t - np.clip(np.linalg.solve(hessian, x.T @ (p - labels) + 1e-3 * len(g) * t * [1, 0.01]), -2, 2)
        if t[0] > 0:
            model.slope, model.shift = float(t[0] / scale), float(t[1])
    return model


def _gather(rows: DataFrame) -> tuple[list[str], Sparse]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [features(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([i.astype(_INDEX).tobytes() for i, _ in found], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["kind", "index", "value"])

    got = rows.select("kind", F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind string, index binary, value binary").toArrow()
    # Rows lie end to end in what arrived: no copy of each is made.
    (index, start), (value, _) = (_end_to_end(got.column(c), kind) for c, kind in ((1, _INDEX), (2, np.float32)))
    return got.column(0).to_pylist(), Sparse(index, value, start)


def _end_to_end(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, and where each row starts."""
    size, place = np.dtype(kind).itemsize, np.int64 if pa.types.is_large_binary(column.type) else np.int32
    parts, lengths = [np.empty(0, kind)], [np.zeros(1, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], place)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
            lengths.append(np.diff(ends) // size)
            if ends[-1] > ends[0]:
                parts.append(np.frombuffer(chunk.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]))
    return np.concatenate(parts), np.cumsum(np.concatenate(lengths))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 3, held_out: int = 1,
        sample: Sample = Sample()) -> Model:
    """Learn from the texts and labels whose fold is not held out."""
    small_batches(docs.sparkSession)
    inside = fold_of(key, folds) != held_out
    # A key with labels that disagree is trusted for nothing.
    marked = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & inside).groupBy(key).agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select(key, "quality")
    share, n = marked.agg(F.avg("quality"), F.count("*")).first()
    if not n:
        return Model(np.zeros(SIZE))
    for_curve = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(4)) == 0
    picks = [bounded_ids(marked.where((F.col("quality") == 1) & ~for_curve), key, sample.positives).withColumn("kind", F.lit("P"))]
    for q, part in ((1, share), (0, 1 - share)):
        picks.append(bounded_ids(marked.where((F.col("quality") == q) & for_curve), key, round(sample.curve * part)).withColumn("kind", F.lit(str(q))))
    ids = docs.where(F.col(key).isNotNull() & inside).select(key).join(labels.select(key), key, "left_anti")
    picks.append(bounded_ids(ids, key, sample.unlabelled).withColumn("kind", F.lit("U")))
    chosen = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]).distinct()
    # The sample is bounded by its parameters, so every task may have it.
    kinds, rows = _gather(docs.select(key, "text").join(F.broadcast(chosen), key))
    kinds = np.array(kinds, dtype=object)
    part = {k: rows.take(np.flatnonzero(kinds == k)) for k in ("P", "U", "0", "1")}
    model = learn(part["P"], part["U"], float(np.clip(share, 0.01, 0.99)))
    both = rows.take(np.flatnonzero((kinds == "0") | (kinds == "1")))
    return calibrate(model, both, (kinds[(kinds == "0") | (kinds == "1")] == "1").astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with its score in a last column of its own, ``quality_score``; ``text`` is read whole."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        hashes = known
        rows = Sparse.of([features(t, hashes) for t in texts])
        import pandas as pd
        return pd.Series(sent.value.score(rows))

    known = WordHashes()
    return docs.withColumn("quality_score", probability(F.col("text").cast("binary")))
