"""Toxicity: the label model on votes with known accuracies, the scores by hand, held-out labels, odd texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import queries, toxicity
from skylattice.llm.sparse import Sparse

SF = "/root/testdata/sf0.1"


def test_label_model_finds_accuracies_and_correlations():
    """Ten voters of known accuracy, the second a copy of the first in nine of ten cases."""
    rng = np.random.default_rng(0)
    n, accuracy = 40_000, np.array([0.9, 0.9, 0.85, 0.8, 0.75, 0.7, 0.8, 0.6, 0.9, 0.7])
    y = (rng.random(n) < 0.3).astype(int)
    votes = np.where(rng.random((n, 10)) < accuracy, y[:, None], 1 - y[:, None])
    copied = rng.random(n) < 0.9
    votes[copied, 1] = votes[copied, 0]
    spoken = rng.random((n, 10)) < 0.8
    spoken[copied, 1] = spoken[copied, 0]
    votes = np.where(spoken, votes + 1, 0)
    names = np.array(["".join(map(str, v)) for v in votes])
    patterns, inverse = np.unique(names, return_inverse=True)
    labelled = rng.random(n) < 0.02
    free = np.bincount(inverse[~labelled], minlength=len(patterns))
    known = np.stack([np.bincount(inverse[labelled & (y == k)], minlength=len(patterns)) for k in (0, 1)], axis=1)
    for anchors, slack in ((known, 0.02), (known * 0, 0.05)):
        model = toxicity.label_model(patterns.tolist(), free, anchors)
        got = np.array([model.accuracy[v] for v in toxicity.VOTERS])
        assert np.abs(got - accuracy)[[0, 2, 3, 4, 5, 6, 7, 8, 9]].max() < slack and abs(model.prior - 0.3) < slack
        assert max(model.correlated, key=model.correlated.get) == toxicity.VOTERS[:2]
        post = np.array([model.posterior[p] for p in names])
        assert np.mean((post >= 0.5) == (y == 1)) > 0.94


def test_label_model_of_nothing():
    assert toxicity.label_model([], np.empty(0), np.empty((0, 2))).posterior == {}


def test_learnt_curve_follows_soft_labels():
    rows = Sparse.of([(np.array([k % 2]), np.array([1.0])) for k in range(400)])
    model = toxicity.learn(rows, np.where(np.arange(400) % 2 == 0, 0.9, 0.2))
    assert np.allclose(model.score(rows)[:2], (0.9, 0.2), atol=0.02)


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity._labels_inside(labels, "doc_id", 3, 1)
    lex = toxicity.lexicon(docs, known)
    marks = toxicity.marked(docs, lex).persist()
    model = toxicity.fit(marks, known)
    yield docs, labels, lex, model, {r.doc_id: r.toxicity for r in toxicity.scored(marks, model).collect()}
    marks.unpersist()


def test_held_out_toxicity(fitted):
    docs, labels, lex, model, scores = fitted
    held = [(r.toxic, scores[r.doc_id] >= 0.7) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 1000 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([p for t, p in held if t == 1]) > 0.9 and np.mean([p for t, p in held if t == 0]) < 0.01


def test_lexicon_holds_no_label_of_the_held_out_fold(spark, fitted):
    docs, labels, lex, *_ = fitted
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.lexicon(docs, toxicity._labels_inside(flipped, "doc_id", 3, 1)).stems == lex.stems


def test_scores_by_hand(fitted):
    """A plain sum over the words of whole texts gives the same scores."""
    docs, _, lex, model, scores = fitted
    for r in docs.orderBy("doc_id").limit(300).collect():
        _, index, value = toxicity.votes_and_features(r.text, lex)
        g = model.bias + sum(model.weights[i] * np.float32(x) for i, x in zip(index, value))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + np.exp(-g)), abs=1e-9)


def test_whole_texts_count(fitted):
    _, _, lex, model, _ = fitted
    score = lambda text: model.score(Sparse.of([tuple(map(np.array, toxicity.votes_and_features(text, lex)[1:]))]))[0]
    clean = "the weather was fine and we went on with our work " * 400
    assert score(clean) < 0.3 and score("") < 0.5
    assert score(clean + "you worthless idiot you stupid loser " * 150) > 0.7
    assert score(clean + "one said the word idiot once") < 0.7


def test_odd_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (11, 0), (3, None), (9, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    docs = docs.withColumn("toxic", F.lit(1)).withColumn("votes", F.lit("x")).unionByName(
        docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars", "id", "1 AS toxic", "'x' AS votes"))
    for told in (labels, labels.limit(0)):
        rows = toxicity.judged(docs, told).collect()
        assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.judged(docs.limit(0), labels).collect() == []
    with_text_ids = toxicity.judged(docs.select("id", "text"), labels.limit(0).withColumnRenamed("doc_id", "id").withColumn("id", F.col("id").cast("string")), "id")
    assert with_text_ids.count() == docs.count()


def test_query(spark):
    rows = queries.op11_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows]
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
