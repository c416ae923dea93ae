"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. ``lexicon``: stems (beginnings of words, and whole words) that labelled toxic texts hold far more often than clean
   ones, from a bounded sample of the labels of the learning folds. Stems with the same first letters are one family;
   families are dealt to ``LEARNT`` lexicons, so these vote on different evidence.
2. ``marked``: one pass over all texts. Each of ``VOTERS`` says toxic, clean or nothing of a text: the learnt lexicons
   and a short list of general insults by the share of their words, the whole lexicon by share and by variety,
   and patterns (shouting, runs of exclamation marks, one insult again and again). The features of the classifier come
   from the same pass.
3. ``label_model``: texts are counted by their votes, over the whole table. A model with a hidden class and, for each
   class, a tree of dependent voters is fitted to the counts by expectation maximisation. The tree joins voters whose
   votes still hold information on one another once the class is known (the maximum spanning forest of their conditional
   mutual information); it tells accuracies and correlations of the voters. Texts with a label of the learning folds
   anchor the classes.
4. ``fit``: logistic regression on the posterior labels of a bounded sample of texts (``Sample``) of the learning folds.

Scores never look at labels, languages, sources or ids, only at whole texts.

Defined results: a null text counts as an empty one; an empty text has no votes, and the score of one without
lexicon words. Labels that disagree on a key, null labels and null keys take no part. Without any labels the list
of general insults is the lexicon and half the voters' majority starts the model. Rows keep their order of keys
undefined; repeated rows are scored each. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.common import small_batches, staged
from skylattice.llm.sparse import Sparse, bounded_ids, fold_of

#: Lengths of the beginnings of words that may be stems; the first letters make the family.
STEMS = range(3, 9)
#: Stems kept at most; how often, how surely and by how much more often they are in toxic texts.
MOST_STEMS = 4096
LEAST_TEXTS, SURE, RATIO = 4, 20.0, 4.0
#: Different words of toxic texts that a beginning must have to be a stem.
LEAST_KINDS = 4
LEARNT = 4
#: General insults, a parameter: words whose only use is to demean.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumb", "loser", "losers", "scum", "scumbag", "trash",
    "pathetic", "worthless", "disgusting", "filthy", "vermin", "clown", "bastard", "jerk", "creep", "freak", "fool", "liar",
    "degenerate", "subhuman", "retard", "whore", "slut", "pig", "maggot", "parasite", "halfwit", "dimwit", "ugly",
)
VOTERS = (*(f"learnt {k}" for k in range(LEARNT)), "insults", "share", "variety", "shouting", "exclaiming", "repeating")
#: Share of words from which a lexicon votes toxic, and the whole lexicon; below the thin share the latter votes clean.
DENSE, DENSE_WHOLE, THIN_WHOLE = 1 / 250, 1 / 100, 1 / 500
_LEAST_WORDS = 20
_ABSTAIN, _CLEAN, _TOXIC = 0, 1, 2
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000

#: Upper ends of the bins of shares (of words, of letters) and of counts.
_SHARES = np.array([0, 1 / 1000, 1 / 500, 1 / 250, 1 / 150, 1 / 100, 1 / 60, 1 / 30, 1 / 15, 1 / 5])
_COUNTS_ENDS = np.array([0, 1, 2, 3, 5, 8, 16, 64])
_BINS = len(_SHARES) + 1
#: Binned figures: every lexicon, the whole, shouting, exclaiming; lexicon words, different ones, words.
_FIGURES = LEARNT + 4 + 3
SIZE = _FIGURES * _BINS + MOST_STEMS


@dataclass(frozen=True)
class Sample:
    """Most labelled texts that the lexicon is learnt from, and texts that the classifier is fitted to."""

    labelled: int = 20_000
    texts: int = 20_000


def stems_of(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if n < len(word)] + [word]


@dataclass
class Lexicon:
    """Numbered stems; those of the general list besides."""

    stems: dict[str, int]
    insults: frozenset[str] = frozenset(INSULTS)
    _known: dict[str, tuple] = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[int, tuple[int, ...], bool]:
        """Number of the learnt lexicon that has the word or -1, its stems, and whether it is a general insult."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            numbers = tuple(self.stems[s] for s in stems_of(word) if s in self.stems)
            part = xxhash.xxh32_intdigest(word[:STEMS[0]]) % LEARNT if numbers else -1
            found = self._known[word] = (part, numbers, word in self.insults)
        return found

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}


def lexicon(docs: DataFrame, marked: DataFrame, key: str = "doc_id", most: int = Sample.labelled) -> Lexicon:
    """Stems of toxic texts, from at most ``most`` of the texts in ``marked (key, toxic)``."""
    small_batches(docs.sparkSession)
    chosen = marked.join(bounded_ids(marked, key, most), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower()))
                counts[toxic].update({s for w in words for s in stems_of(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
                pa.array([c[s] for s in names], pa.int64()) for c in counts)], ["stem", "clean", "toxic"])

    # The sample is bounded by its parameter, so every task may have it.
    texts = docs.where("text IS NOT NULL").select(key, "text").join(F.broadcast(chosen), key).select(F.col("toxic").cast("int"), "text")
    n = {r["toxic"]: r["n"] for r in chosen.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({})
    every = staged(texts.mapInArrow(run, "stem string, clean long, toxic long").groupBy("stem").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    # A beginning stands for its words only where toxic texts go on from it in several ways.
    words = every.where("toxic > 0 AND NOT endswith(stem, '*')")
    begins = F.explode(F.array(*[F.when(F.length("stem") > n, F.concat(F.left("stem", F.lit(n)), F.lit("*"))) for n in STEMS]))
    many = words.select(begins.alias("stem")).groupBy("stem").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= LEAST_KINDS)
    whole = F.col("stem").endswith("*") == F.lit(False)
    counted = every.join(many, "stem", "left").where((F.col("toxic") >= LEAST_TEXTS) & (whole | F.col("kinds").isNotNull()))
    a, b, share = F.col("toxic"), F.col("clean"), n[1] / (n[0] + n[1])
    surprise = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    ratio = (a / n[1]) / ((b + 0.5) / n[0])
    best = counted.where((ratio >= RATIO) & (surprise >= SURE)).orderBy(surprise.desc(), "stem").limit(MOST_STEMS)
    return Lexicon({r["stem"]: k for k, r in enumerate(best.select("stem").collect())})


def _share_bin(x: float) -> int:
    return int(np.searchsorted(_SHARES, x, "left"))


def _vote(hits: int, n: int) -> int:
    return _ABSTAIN if not hits else _TOXIC if hits >= DENSE * n else _CLEAN


def votes_and_features(text: str | None, lex: Lexicon) -> tuple[list[int], list[int], list[float]]:
    """What each voter says of a whole text, and the features of the classifier (numbers and values)."""
    text = text or ""
    words = Counter(_WORD.findall(text.lower()))
    n = max(1, sum(words.values()))
    parts, insults, whole, kinds, top, stems = [0] * LEARNT, 0, 0, 0, 0, Counter()
    for word, times in words.items():
        part, numbers, insult = lex.look_up(word)
        if part >= 0:
            parts[part] += times
            for s in numbers:
                stems[s] += times
        insults += times * insult
        if part >= 0 or insult:
            whole, kinds, top = whole + times, kinds + 1, max(top, times)
    letters = sum(map(str.isalpha, text)) if whole or text.isupper() else 0
    upper = sum(map(str.isupper, text)) / letters if letters else 0.0
    runs = text.count("!!") / n
    votes = [*(_vote(h, n) for h in parts), _vote(insults, n),
             _TOXIC if whole and whole >= DENSE_WHOLE * n else _CLEAN if n >= _LEAST_WORDS and whole < THIN_WHOLE * n else _ABSTAIN,
             _TOXIC if kinds >= 2 else _ABSTAIN if kinds else _CLEAN,
             _TOXIC if upper > 0.6 else _ABSTAIN, _TOXIC if runs > 0.1 else _ABSTAIN, _TOXIC if top >= 3 else _ABSTAIN]
    bins = [_share_bin(x) for x in (*(h / n for h in parts), insults / n, whole / n, upper, runs)]
    bins += [int(np.searchsorted(_COUNTS_ENDS, x, "left")) for x in (whole, kinds, np.log2(n) * 2)]
    index = [f * _BINS + b for f, b in enumerate(bins)] + [_FIGURES * _BINS + s for s in stems]
    return votes, index, [1.0] * len(bins) + [min(1.0, 20 * c / n) for c in stems.values()]


def marked(docs: DataFrame, lex: Lexicon, key: str = "doc_id") -> DataFrame:
    """``key``, ``votes`` as one digit a voter, and the features of every text of ``docs``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes_and_features(t, sent.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(["".join(map(str, v)) for v, _, _ in found], pa.string()),
                pa.array([np.array(i, np.int16).tobytes() for _, i, _ in found], pa.binary()),
                pa.array([np.array(x, np.float32).tobytes() for _, _, x in found], pa.binary())], [key, "votes", "index", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, votes string, index binary, value binary")


@dataclass
class LabelModel:
    """Probability of a toxic text for each pattern of votes, and what was learnt of the voters."""

    posterior: dict[str, float]
    prior: float
    #: How often a voter that says something is right.
    accuracy: dict[str, float]
    #: Voters that depend on one another given the class, with their conditional mutual information in nats.
    correlated: dict[tuple[str, str], float]


def _tables(votes: np.ndarray, weight: np.ndarray, parents: list[int]) -> list[np.ndarray]:
    """Log probabilities of each voter's vote by class and its parent's vote (one column where it has none)."""
    found = []
    for j, parent in enumerate(parents):
        table = np.ones((2, 3 if parent >= 0 else 1, 3))
        above = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
        for y in (0, 1):
            np.add.at(table[y], (above, votes[:, j]), weight[:, y])
        found.append(np.log(table / table.sum(axis=2, keepdims=True)))
    return found


def _expected(votes: np.ndarray, tables: list[np.ndarray], parents: list[int], prior: float) -> np.ndarray:
    """Probability of class 1 for each pattern."""
    logs = np.tile(np.log([1 - prior, prior]), (len(votes), 1))
    for j, (parent, table) in enumerate(zip(parents, tables)):
        above = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
        logs += table[:, above, votes[:, j]].T
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def _dependence(votes: np.ndarray, weight: np.ndarray, i: int, j: int) -> float:
    """Conditional mutual information of two voters given the class."""
    total, found = weight.sum(), 0.0
    for y in (0, 1):
        joint = np.zeros((3, 3))
        np.add.at(joint, (votes[:, i], votes[:, j]), weight[:, y])
        n = joint.sum()
        if n > 0:
            apart = joint.sum(1, keepdims=True) @ joint.sum(0, keepdims=True) / n
            some = joint > 0
            found += (joint[some] * np.log(joint[some] / apart[some])).sum()
    return float(found / total) if total else 0.0


def _forest(votes: np.ndarray, weight: np.ndarray, least: float) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Parent of each voter in the maximum spanning forest of dependences, and its edges."""
    count = votes.shape[1]
    edges = sorted(((_dependence(votes, weight, i, j), i, j) for i in range(count) for j in range(i)), reverse=True)
    group, kept = list(range(count)), {}
    for strength, i, j in edges:
        if strength >= least and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
            kept[(j, i)] = strength
    parents, seen = [-1] * count, set()
    for start in range(count):
        waiting = [start] if start not in seen else []
        while waiting:
            now = waiting.pop()
            seen.add(now)
            for a, b in kept:
                for here, there in ((a, b), (b, a)):
                    if here == now and there not in seen:
                        parents[there] = now
                        waiting.append(there)
    return parents, kept


def label_model(patterns: list[str], free: np.ndarray, known: np.ndarray, rounds: int = 40, least: float = 0.002) -> LabelModel:
    """Fit the classes to ``free`` texts and to ``known`` ones (clean, toxic) of each pattern of votes."""
    if not patterns:
        return LabelModel({}, 0.0, {}, {})
    votes = np.array([[int(c) for c in p] for p in patterns])
    free, known = free.astype(float), known.astype(float)
    if known.sum(axis=0).min() > 0:
        # Labels count as much as all other texts together, so the hidden class stays theirs.
        known = known * max(1.0, free.sum() / known.sum())
        parents = [-1] * votes.shape[1]
        weight, prior = known, known[:, 1].sum() / known.sum()
        post = _expected(votes, _tables(votes, weight, parents), parents, prior)
    else:
        known, parents = known * 0, [-1] * votes.shape[1]
        for_, against = (votes == _TOXIC).sum(1), (votes == _CLEAN).sum(1)
        post = np.where(for_ > against, 0.9, np.where(for_ < against, 0.05, 0.1))
    kept: dict[tuple[int, int], float] = {}
    for step in range(2 * rounds):
        weight = known + free[:, None] * np.stack([1 - post, post], axis=1)
        if step == rounds:
            parents, kept = _forest(votes, weight, least)
        prior = float(np.clip(weight[:, 1].sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6))
        post = _expected(votes, _tables(votes, weight, parents), parents, prior)
    said = {name: weight[votes[:, j] == _TOXIC, 1].sum() + weight[votes[:, j] == _CLEAN, 0].sum() for j, name in enumerate(VOTERS[:votes.shape[1]])}
    spoke = {name: weight[votes[:, j] != _ABSTAIN].sum() for j, name in enumerate(VOTERS[:votes.shape[1]])}
    return LabelModel(dict(zip(patterns, post.tolist())), prior, {k: float(said[k] / spoke[k]) for k in said if spoke[k] > 0},
                      {(VOTERS[a], VOTERS[b]): s for (a, b), s in kept.items()})


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def score(self, rows: Sparse) -> np.ndarray:
        return 0.5 * (1 + np.tanh((rows.dot(self.weights) + self.bias) / 2))


def learn(rows: Sparse, target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Logistic regression on soft labels by full-batch steps with running moments."""
    theta, m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    if len(rows):
        share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
        theta[-1] = np.log(share / (1 - share))
    for step in range(1, steps + 1) if len(rows) else ():
        error = (Model(theta[:-1], theta[-1]).score(rows) - target) / len(rows)
        grad = np.append(rows.transposed_dot(error, SIZE) + decay * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:-1], float(theta[-1]))


def _labels_inside(labels: DataFrame, key: str, folds: int, held_out: int) -> DataFrame:
    """``key, toxic`` where the fold is not held out and the labels of the key agree."""
    inside = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(key, folds) != held_out))
    return inside.groupBy(key).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select(key, "toxic")


def fit(marks: DataFrame, known: DataFrame, key: str = "doc_id", folds: int = 3, held_out: int = 1, most: int = Sample.texts) -> Model:
    """Label model over all of ``marks`` and the labels ``known (key, toxic)``, then the classifier on a sample."""
    # At most three answers a voter, so at most 3 ** voters rows, whatever the size of the table.
    seen = marks.join(known, key, "left").groupBy("votes").agg(
        F.count_if(F.col("toxic").isNull()).alias("free"), F.count_if(F.col("toxic") == 0).alias("clean"),
        F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("votes").collect()
    labels = label_model([r["votes"] for r in seen], np.array([r["free"] for r in seen]), np.array([(r["clean"], r["toxic"]) for r in seen]).reshape(-1, 2))
    inside = marks.where(F.col(key).isNotNull() & (fold_of(key, folds) != held_out))
    chosen = bounded_ids(inside.select(key).distinct(), key, most)
    got = inside.join(F.broadcast(chosen), key, "left_semi").select("votes", "index", "value").toArrow()
    rows = sorted(zip(*(got.column(i).to_pylist() for i in range(3))))  # one order, whatever task was first
    model = learn(Sparse.of([(np.frombuffer(i, np.int16), np.frombuffer(x, np.float32)) for _, i, x in rows]),
                  np.array([labels.posterior[v] for v, _, _ in rows]))
    model.labels = labels
    return model


def scored(marks: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, toxicity`` for each row of ``marks``."""
    sent = marks.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            rows = Sparse.of([(np.frombuffer(i, np.int16), np.frombuffer(x, np.float32))
                              for i, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows), pa.float64())], [key, "toxicity"])

    kind = marks.schema[key].dataType.simpleString()
    return marks.select(key, "index", "value").mapInArrow(run, f"`{key}` {kind}, toxicity double")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 3, held_out: int = 1, sample: Sample = Sample()) -> DataFrame:
    """``key, toxicity`` for each row of ``docs``, learnt from ``labels (key, toxic)`` outside the held-out fold."""
    docs = docs.select(key, "text")
    known = staged(_labels_inside(labels.select(key, "toxic"), key, folds, held_out))
    marks = staged(marked(docs, lexicon(docs, known, key, sample.labelled), key))
    return scored(marks, fit(marks, known, key, folds, held_out, sample.texts), key)
