"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skylattice.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near_by_hand(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(counts, least_letters=6, least_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(k, ()) if near_by_hand(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return rows


def counts_by_hand(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_comparison_of_all_words(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = variants_by_hand(counts_by_hand(docs))
    assert rows_of(queries.op13_spelling_variants(spark, SF)) == expected
    assert any(r[0] for r in expected.values())


def random_words(rng, n, letters="abé", lengths=(6, 7, 8, 9)):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([5, 5, 7, 25, 26, 200, 5000]) for _ in range(n)}


@pytest.mark.parametrize("tile", [7, 4096])
def test_crowded_vocabulary(spark, tile):
    """Few letters, so that words have many near ones and chains of forms; small tiles split every group."""
    words = random_words(random.Random(3), 500)
    words |= {"aaaaaa" + "é" * 9 + x: 5 for x in "abcdefghij"} | {"ab": 9, "àÀÿðþßæ": 5, "àÀÿðþßa": 25}
    words.pop("ab")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = variants_by_hand(words)
    assert rows_of(spelling.variants(df, tile=tile)) == expected
    assert any(r[1] != r[0] for r in expected.values() if r[0])


def test_words_with_a_common_beginning(spark):
    """One beginning holds most words: its group is dealt to tiles and no link is lost."""
    rng = random.Random(5)
    words = {"commonbeginning" + "".join(rng.choice("abcd") for _ in range(rng.choice((7, 8)))): rng.randrange(5, 400) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, tile=64)) == variants_by_hand(words)


def test_odd_documents(spark):
    long = "wording " * 50_000 + "woding " * 30
    rows = [(1, None), (2, ""), (3, "1 2 漢字 ..."), (4, long), (4, long), (None, "Wordings ÀÉÎÕÜØ ÀÉÎÕÜØ " * 6), (5, "aXbYcZ×÷ " * 7)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    words = spelling.misspelt(spelling.occurrences(docs))
    # A null id draws no checksum, so its words stay as they are.
    expected = counts_by_hand([r for r in rows if r[0] is not None]) + Counter({"wordings": 6, "ÀÉÎÕÜØ": 12})
    assert {r.word: r.n for r in spelling.vocabulary(words, 1, 1).collect()} == expected
    assert rows_of(spelling.variants(spelling.vocabulary(words))) == variants_by_hand(expected)
    assert spelling.variants(spelling.vocabulary(spelling.occurrences(docs.limit(0)))).collect() == []


def test_bit_index_by_hand():
    rng = random.Random(1)
    words = list(random_words(rng, 300, lengths=(6, 7)))
    for size in (6, 7):
        part = [w for w in words if len(w) == size]
        index = spelling.BitIndex(part)
        for q in [w for w in words if len(w) == 6]:
            found = index.replaced(q) if size == 6 else index.inserted(q)
            assert {part[k] for k in index.numbers(found)} == {w for w in part if near_by_hand(q, w)}
