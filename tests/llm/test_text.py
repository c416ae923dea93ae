"""Quality, language, decontamination, mixing and archives."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import decontaminate, language, mixing, quality, warc
from skylattice.llm.sparse import Sparse

SF = "/root/testdata/sf0.01"


# --- quality -------------------------------------------------------------------------------

def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "quality_score", "quality").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [(r.quality_score >= 0.5) == (r.quality == 1) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.93
    assert all(0 <= r.quality_score <= 1 for r in scored)


def test_rows_are_taken_in_little_memory(monkeypatch):
    """Taking rows costs little beside the rows taken."""
    import tracemalloc

    from skylattice.llm import sparse
    monkeypatch.setattr(sparse, "BLOCK", 1 << 14)
    rng = np.random.default_rng(1)
    rows = sparse.Sparse.of([(np.arange(n), rng.random(n)) for n in rng.integers(0, 400, 4000)])
    order = rng.permutation(len(rows))[:3000]
    tracemalloc.start()
    got = rows.take(order)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (got.index.nbytes + got.value.nbytes)
    for k, i in enumerate(order):
        for a, b in ((got.index, rows.index), (got.value, rows.value)):
            assert (a[got.start[k]:got.start[k + 1]] == b[rows.start[i]:rows.start[i + 1]]).all()
    packed = quality.pa.chunked_array([quality.pa.array([b"ab", b"", b"cdef"]), quality.pa.array([b"", b"gh"]).slice(1), quality.pa.array([], quality.pa.binary())])
    values, start = quality._end_to_end(packed, np.uint16)
    assert values.tobytes() == b"abcdefgh" and start.tolist() == [0, 1, 1, 3, 4]


def test_quality_of_odd_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 1), (11, 0), (3, None), (9, 0), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r.quality_score is not None and 0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).collect() == []
    bare = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.score(docs, bare).collect()} == {0.5}


def test_risk_stays_unbiased_and_not_negative():
    """Positives and an unlabelled mixture are enough to part the classes."""
    rng = np.random.default_rng(0)
    one = lambda kind: (np.array([kind, 10 + rng.integers(5)]), np.array([1.0, 0.3]))
    positive = Sparse.of([one(0) for _ in range(300)])
    unlabelled = Sparse.of([one(0) for _ in range(420)] + [one(1) for _ in range(180)])
    model = quality.learn(positive, unlabelled, 0.7)
    g = Sparse.of([one(0) for _ in range(20)] + [one(1) for _ in range(20)]).dot(model.weights) + model.bias
    assert (g[:20] > 0).all() and (g[20:] < 0).all()


# --- language ------------------------------------------------------------------------------

def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id"), "text", "lang")
    model = language.fit(docs)
    found = {r.id: r for r in language.identify(docs.select(F.col("doc_id").alias("id"), "text"), model).collect()}
    held = [(r.lang, found[r.doc_id]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([a == b.lang_pred for a, b in held]) > 0.97
    accepted = [(a, b) for a, b in held if not b.rejected]
    assert np.mean([a == b.lang_pred for a, b in accepted]) > 0.97 and len(accepted) > 0.8 * len(held)


def test_language_of_odd_texts(texts, docs):
    rows = language.identify(texts, language.fit(docs)).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == texts.count() and {i for i, r in got.items() if r.lang_pred == "und"} == {4, 5, 13}
    assert all(0 <= r.score <= 1 for r in rows) and got[4].score == 0
    assert {r.lang_pred for r in language.identify(texts, language.fit(docs.limit(0))).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    assert language.letters("½ ②x²y Ⅷ a1b é漢 १२") == ["x", "y", "a", "b", "é漢"]
    rows = [(1, "½ ²"), (2, "①② 12 ١"), (3, "the and"), (None, "the and of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = language.fit(docs)
    got = {r.id: (r.lang_pred, r.score) for r in language.identify(docs.withColumnRenamed("doc_id", "id"), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == got[None][0]


# --- decontamination -----------------------------------------------------------------------

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_by_hand(text, items, window):
    words = WORDS.findall(text.encode().lower()) if text is not None else []
    hit, found = set(), set()
    for i, t in items:
        own = WORDS.findall(t.encode().lower()) if t is not None else []
        n = min(window, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k:k + n] == own[j:j + n]:
                    hit.update(range(k, k + n))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("slice_bytes", [60, 1 << 20])
def test_decontamination(spark, docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    items = [(1, "Short, TEXT!"), (2, None), (3, "..."), (10, " ".join(f"shared{i}" for i in range(3, 40))), (11, "word word word word"),
             (12, "漢字 ñ"), (13, " ".join(f"token{i * 31 % 4001}" for i in range(3990, 4015))), (3, "before it shared0")]
    got = decontaminate.judged(docs.withColumn("n_words", F.lit("old")), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == hits_by_hand(r.text, items, 10), r.doc_id
        assert r.contaminated == (r.n_hit > 0)
        words, own = (WORDS.findall(x.encode().lower()) if x else [] for x in (r.text, ""))
        for m in r.matches:
            assert m.start + m.length <= len(words)
    longest = {(m.item, m.start, m.length) for r in got if r.doc_id == 10 for m in r.matches}
    assert longest == {("10", 3, 37)}


def test_decontamination_of_nothing(spark, docs):
    items = spark.createDataFrame([], "item_id int, text string")
    assert not any(r.contaminated for r in decontaminate.judged(docs, items).collect())
    assert decontaminate.judged(docs.limit(0), items).collect() == []


# --- mixing --------------------------------------------------------------------------------

def test_raking_meets_the_marginals():
    rng = np.random.default_rng(2)
    a, b, c = (x.ravel() for x in np.meshgrid(range(4), range(3), range(2), indexing="ij"))
    seen = rng.integers(1, 1000, 24).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, np.nan]), np.array([0.7, 0.3])]
    raked = mixing.rake(seen, list(zip((a, b, c), targets)))
    assert np.bincount(a, raked) / seen.sum() == pytest.approx(targets[0])
    assert np.bincount(c, raked) / seen.sum() == pytest.approx(targets[2])
    assert (np.bincount(b, raked) / seen.sum())[2] == pytest.approx((np.bincount(b, seen) / seen.sum())[2])
    for share in (0.05, 0.5, 0.9, 1.0):
        p = mixing.probabilities(seen, raked, share)
        assert (p >= 0).all() and (p <= 1).all() and (p * seen).sum() == pytest.approx(share * seen.sum())


def test_mixture_of_odd_texts(docs):
    rows = mixing.mixed(docs.withColumn("taken", F.lit(0)).withColumn("probability", F.lit(0))).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (4, 5, 6, 13)} == {4: 0, 5: 0, 6: 2, 13: 0}
    assert {r.class_source for r in rows if r.doc_id in (4, 5)} == {"*"}
    assert mixing.mixed(docs.limit(0)).collect() == []


# --- archives ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b/", big), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "tiny é"),
            (6, "http://d/", "tiny é"), (7, "http://e/é", "é" * 70), (8, "http://f/", "é" * 70), (9, "http://g/", "z" * 300_000),
            (2, "http://b/", big), (None, "http://h/", big)]
    return spark.createDataFrame(rows, "id long, uri string, payload string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, pages, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(pages), path, compression=compression)
    got = warc.read_archives(spark, f"file://{path}").collect()
    plain = [(r.id, (r.payload or "").encode()) for r in pages.where("id IS NOT NULL").collect()]
    first = {}
    for i, b in sorted(plain):
        first.setdefault(b, i)
    expected = sorted((f"<urn:x-record:{i}>", *(("response", b, None) if len(b) < 100 or first[b] == i else ("revisit", b"", f"<urn:x-record:{first[b]}>")),
                       len(b), "sha256:" + hashlib.sha256(b).hexdigest()) for i, b in plain)
    assert sorted((r.record_id, r.record_type, bytes(r.payload), r.refers_to, r.payload_length, r.payload_digest) for r in got) == [
        (a, b, c, d, e, f) for a, b, c, d, e, f in expected]
    assert {r.target_uri for r in got if r.record_id == "<urn:x-record:1>"} == {"http://a/%0D%0AX: y"}


def test_header_predicates_reach_the_reader(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(pages), path)
    found = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://f%'")
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "")
    assert [(r.record_id, r.payload) for r in found.collect()] == [("<urn:x-record:8>", None)]


def test_unwanted_payloads_are_not_read():
    class Counting:
        def __init__(self, raw):
            import io
            self.raw, self.got = io.BytesIO(raw), 0

        def read(self, n):
            self.got += n
            return self.raw.read(n)

        def __getattr__(self, name):
            return getattr(self.raw, name)

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000\r\n\r\n" + b"x" * 5000 + b"\r\n\r\n"
    stream = Counting(record * 3)
    assert list(warc.records(stream, lambda h: False, True)) == [] and stream.got == 0


def test_broken_archives(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(Exception, match="offset 0"):
        warc.read_archives(spark, str(tmp_path)).collect()
