"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are the word itself and its character n-grams, with marks at both ends, hashed into
``BUCKETS`` rows of an embedding. A text is the average over the subwords of all its words; a linear layer
and a softmax give the languages. Both layers are trained by stochastic gradient descent in numpy on a
bounded sample, picked by a hash of the id. Part of that sample calibrates: a temperature for the
probabilities, and the least probability at which so many accepted texts are right (``PRECISION``); below
it a text is marked as rejected.

As the model is linear after the average, scoring needs one row of logits per different word.

Defined results: letters are those of Unicode, so numerals such as ½ or Ⅷ are none; a null id has no fold and is never learnt from; a null text, or one without any letter, is ``und`` with score 0 and rejected; without any
texts to learn from, every text is ``und``; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.common import small_batches
from skylattice.llm.sparse import Sparse, bounded_ids, fold_of

BUCKETS = 1 << 14
WIDTH = 16
GRAMS = (2, 3, 4)
LEARN_TEXTS = 4000
PRECISION = 0.99
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def letters(text: str) -> list[str]:
    """Runs of letters of a text, in lower case; numerals that are no digits are no letters either."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return " ".join(w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w) for w in found).split()


def subwords(word: str) -> list[int]:
    """Bucket of the word and of each of its n-grams."""
    marked, digest = f"<{word}>", xxhash.xxh32_intdigest
    return [digest(marked) % BUCKETS, *(digest(marked[i:i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1))]


class Subwords(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = np.array(subwords(word), np.int64)
        return value


def features(text: str | None, known: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Share of each bucket among the subwords of a whole text."""
    total = np.zeros(BUCKETS, np.float32)
    for word, times in Counter(letters(text or "")).items():
        np.add.at(total, known[word], times)
    index = np.flatnonzero(total)
    return index, total[index] / max(1.0, float(total.sum()))


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits_of_buckets(self) -> np.ndarray:
        return self.embedding @ self.layer

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        return _softmax((averages + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.size else x
    return e / e.sum(axis=1, keepdims=True) if x.size else x


def learn(rows: Sparse, labels: np.ndarray, languages: list[str], updates: int = 400, batch: int = 64, rate: float = 2.0,
          seed: int = 5) -> Model:
    """Plain stochastic gradient descent on both layers, with a rate that falls to nought."""
    epochs = -(-updates * batch // max(1, len(rows)))
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.3, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages))), np.zeros(len(languages)))
    steps, done = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = rows.take(order[at:at + batch])
            truth = np.eye(len(languages))[labels[order[at:at + batch]]]
            kinds, place = np.unique(part.index, return_inverse=True)
            local = Sparse(place, part.value, part.start)
            hidden = local.dot(model.embedding[kinds])
            error = (_softmax(hidden @ model.layer + model.bias) - truth) / len(truth)
            step = rate * (1 - done / steps)
            back = error @ model.layer.T
            model.layer -= step * hidden.T @ error
            model.bias -= 0.1 * step * error.sum(axis=0)
            model.embedding[kinds] -= 20 * step * local.transposed_dot(back, len(kinds))
            done += 1
    return model


def calibrate(model: Model, rows: Sparse, labels: np.ndarray) -> Model:
    """Temperature by least log loss; the least accepted probability by the wished precision."""
    if not len(rows):
        return model
    logits = rows.dot(model.logits_of_buckets())
    def loss(t: float) -> float:
        p = _softmax((logits + model.bias) / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = min(np.geomspace(0.1, 10, 60), key=loss)
    p = model.probabilities(logits)
    best, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    model.least = float(best[order[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, key: str = "doc_id", folds: int = 4, held_out: int = 2, most: int = LEARN_TEXTS) -> Model | None:
    """Learn from the texts with a language whose fold is not held out."""
    small_batches(docs.sparkSession)
    usable = docs.where((fold_of(key, folds) != held_out) & F.col(key).isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded_ids(usable, key, most).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Subwords()
        for b in batches:
            found = [features(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([i.astype(np.int16).tobytes() for i, _ in found], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["lang", "index", "value"])

    got = usable.select(key, "lang", "text").join(F.broadcast(chosen), key).select("lang", "text").mapInArrow(
        run, "lang string, index binary, value binary").toArrow()
    names, texts = got.column(0).to_pylist(), [
        (np.frombuffer(i, np.int16), np.frombuffer(v, np.float32)) for i, v in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
    kept = [i for i, (index, _) in enumerate(texts) if len(index)]
    if not kept:
        return None
    languages = sorted({names[i] for i in kept})
    # The order in which rows arrive may change from run to run; the sample's must not.
    kept.sort(key=lambda i: (names[i], texts[i][0].tobytes(), texts[i][1].tobytes()))
    labels = np.array([languages.index(names[i]) for i in kept])
    rows = Sparse.of([texts[i] for i in kept])
    for_curve = np.arange(len(kept)) % 5 == 0
    model = learn(rows.take(np.flatnonzero(~for_curve)), labels[~for_curve], languages)
    return calibrate(model, rows.take(np.flatnonzero(for_curve)), labels[for_curve])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``id, lang_pred, score, rejected`` per row of ``docs (id, text)``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = model.logits_of_buckets() if model else None
        known: dict[str, int] = {}
        #: Sum of logits and number of subwords of each known word.
        rows = np.zeros((0, len(model.languages) + 1 if model else 1))
        for b in batches:
            words = [Counter(letters(t)) if t and model else Counter() for t in b.column(1).to_pylist()]
            flat, lengths = [], []
            for found in words:
                for w in found:
                    if w not in known:
                        known[w] = len(known)
                        ids = subwords(w)
                        flat += ids
                        lengths.append(len(ids))
            if lengths:
                sums = np.add.reduceat(table[flat], np.cumsum([0, *lengths[:-1]]), axis=0)
                rows = np.vstack([rows, np.column_stack([sums, lengths])])
            pred, score, reject = ["und"] * len(words), [0.0] * len(words), [True] * len(words)
            some = [i for i, found in enumerate(words) if found]
            if some:
                place = np.fromiter((known[w] for i in some for w in words[i]), np.int64)
                times = np.fromiter((n for i in some for n in words[i].values()), float)
                first = np.cumsum([0, *(len(words[i]) for i in some[:-1])])
                total = np.add.reduceat(rows[place] * times[:, None], first, axis=0)
                p = model.probabilities(total[:, :-1] / total[:, -1:])
                for i, k, best in zip(some, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    pred[i], score[i], reject[i] = model.languages[k], best, best < model.least
            if len(known) > _CACHE:
                known.clear()
                rows = rows[:0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(reject, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
