"""Deduplication of lines, units, byte strings, documents and embeddings, against plain computations."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import embedding_dedup, line_dedup, near_dup, suffix_dedup, unit_dedup
from skylattice.llm.common import components
from skylattice.llm.text import WordHashes

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- union-find ----------------------------------------------------------------------------

def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    links += [(5, 5), (7, 6), (6, 7), (40, 300)]
    random.Random(1).shuffle(links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == roots(nodes, [x for x in links if x[0] != x[1]])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")).collect() == []


# --- documents -----------------------------------------------------------------------------

def near_by_hand(rows, rule):
    hashes = WordHashes()
    sets = {i: rule.sets_of(hashes, t.encode() if t is not None else None) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if rule.linked(sets[a], sets[b])]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("rule", [near_dup.Rule(3, 85), near_dup.Rule()])
def test_near_duplicates(texts, rule):
    found = near_dup.near_duplicates(texts, rule).collect()
    expected = near_by_hand([(r.id, r.text) for r in texts.collect()], rule)
    assert len(found) == texts.count() and {r.id: (r.n_shingles, r.component_id) for r in found} == expected
    assert expected[2][1] == 1 and expected[3][1] == 1 and expected[4] == (0, 4) and expected[7][1] == 6 and expected[14][1] == 8


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rule = near_dup.Rule(3, 85)
    found = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, rule).collect()}
    assert found == near_by_hand([(r.id, r.text) for r in docs.collect()], rule)


def test_near_duplicates_whose_hub_does_not_reach_all(spark):
    """A chain of texts, each like the next only: the links that stars miss are found in the second round."""
    words = [f"w{i}" for i in range(130)]
    rows = [(k, " ".join(f"v{k}x{i}" if i < 4 * k else w for i, w in enumerate(words))) for k in range(12)]
    rule = near_dup.Rule(1, 90)
    found = {r.id: (r.n_shingles, r.component_id) for r in
             near_dup.near_duplicates(spark.createDataFrame(rows, "id long, text string"), rule).collect()}
    assert found == near_by_hand(rows, rule)


def test_no_documents(texts):
    assert near_dup.near_duplicates(texts.limit(0)).collect() == []


def test_pigeonhole_finds_every_signature_within_reach():
    rng = np.random.default_rng(0)
    distance = near_dup.reach(85)
    parts = near_dup.chunks(distance)
    assert sum(len(p) for p in parts) == near_dup.HASHES and 2 * len(parts) > distance
    a = rng.integers(0, 256, (200, near_dup.HASHES)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dup.HASHES, distance, replace=False)
        row[at] ^= rng.integers(1, 256, distance).astype(np.uint8)
    x, y = (near_dup.lookup_keys(s, parts) for s in (a, b))
    assert (x == y).any(axis=1).all()


# --- lines ---------------------------------------------------------------------------------

def line_shingles(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def lines_by_hand(rows):
    place = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip():
                place.setdefault(line, []).append((i, k))
    kinds = sorted(place)
    sets = [line_shingles(x) for x in kinds]
    links = [(a, b) for a in range(len(kinds)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(len(kinds)), links)
    first = {}
    for k, line in enumerate(kinds):
        first[root[k]] = min(first.get(root[k], (10**9, 0)), min(place[line]))
    return {p: first[root[k]] for k, line in enumerate(kinds) for p in place[line]}


def test_lines(spark, docs):
    extra = [(20, "one two three four five six seven eight nine ten eleven twelve\n\nlast"),
             (22, "漢字仮名交じり文の行を二つ並べて比べるための長い文です。\n" + "q" * 40 + "abc\ntab\tbed words in a line of some length"),
             (23, "漢字仮名交じり文の行を二つ並べて比べるための長い文です!\n" + "q" * 40 + "abd\ntab\tbed words in a line of some lengths"),
             (24, "q" * 16 + "r" * 400 + "z" * 16 + "\n" + "q" * 16 + "s" * 400 + "z" * 16), (25, "a b c d e f g h i j k l m n\na b c d e f g h i j k l m n o  p"),
             (21, "LAST\none two three four five six seven eight nine ten eleven twelve!\nlast")]
    rows = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(*e, "s") for e in extra], "doc_id long, text string, source string"))
    found = line_dedup.line_components(rows).collect()
    expected = lines_by_hand([(r.doc_id, r.text) for r in rows.collect()])
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in found} == expected
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc, r.first_line)) for r in found)


def test_lines_whose_hub_does_not_reach_all(spark):
    """Many variants of one line, some of them far from the middle: links beside the star are found."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(120):
        variant = list(words)
        for k in rng.sample(range(40), rng.choice([1, 2, 3, 5, 8])):
            variant[k] = f"other{rng.randrange(3)}"
        rows.append((i, " ".join(variant)))
    found = line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in found} == lines_by_hand(rows)


def lines_by_plain_shingles(rows):
    """Links by the five characters from each character on, for texts of one line."""
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for _, x in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(len(rows)), links)
    return {(i, 0): (rows[root[k]][0], 0) for k, (i, _) in enumerate(rows)}


def test_lines_with_one_changed_character(spark):
    """One typo leaves most shingles of a line, in short lines and in scripts without spaces too."""
    rng = random.Random(5)
    rows = []
    for n in (57, 101, 125, 163, 400) * 8:
        line = ""
        while len(line) < n:
            line += "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) + " "
        k = rng.randrange(n)
        rows += [line[:n], line[:k] + "#" + line[k + 1:n]]
    rows += ["漢字仮名交じり文の行を二つ並べて比べるための長い文です。東京都千代田区の話", "漢字仮名交じり文の行を二つ並べて比べるための長い文です。東京都千代田区の話!",
             "one\ttwo three four five six", "one\ttwo three four five six.", "𝔸𝔹ℂ𝔻𝔼𝔽𝔾ℍ𝕀𝕁𝕂𝕃𝕄", "𝔸𝔹ℂ𝔻𝔼𝔽𝔾ℍ𝕀𝕁𝕂𝕃𝕄é", "abc", "abcd", "abc "]
    rows = list(enumerate(rows))
    found = line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = lines_by_plain_shingles(rows)
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in found} == expected
    assert sum(p[0] != first[0] for p, first in expected.items()) >= 40


def test_every_character_lies_in_a_shingle(spark):
    """A line that is changed in one place has another set of shingles, wherever the place is."""
    lines = ["2019-03-04T00:00:00.000Z market.session.open", "/home/alice/data/corpus/raw.txt /srv/mirror/corpus/raw-v2.txt",
             "Download https://example.org/a1/file.tgz https://example.org/b/sum.txt", "漢字仮名交じり文の行を二つ並べて比べる", "tab\tbed words", "abc"]
    rows = [(n, k, line[:k] + "#" + line[k + 1:] if k >= 0 else line) for n, line in enumerate(lines) for k in range(-1, len(line))]
    table = spark.createDataFrame(rows, "n int, k int, line string").select("n", "k", F.expr(line_dedup._shingles("line")).alias("s"))
    sets = {(r.n, r.k): frozenset(r.s) for r in table.collect()}
    assert all(s != sets[n, -1] for (n, k), s in sets.items() if k >= 0)


def test_lines_alike_at_the_starts_of_words_stay(spark):
    rows = ["2019-03-04T00:00:00.000Z market.session.open", "2024-11-28T00:00:00.000Z market.session.open",
            "/home/alice/data/corpus/raw.txt /srv/mirror/corpus/raw-v2.txt", "/proj/zeta9/data/corpus/raw.txt /srv/mirror/corpus/raw-v2.txt"]
    found = line_dedup.line_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(r.kept for r in found)


def test_pairs_of_a_bucket_meet_by_bits(spark, monkeypatch):
    """No row is made for pairs that two whole numbers a line tell apart, so a bucket's rows do not grow with its square."""
    rng, seen, compared = random.Random(6), [], line_dedup._compared
    monkeypatch.setattr(line_dedup, "_compared", lambda pairs, sets: seen.append(pairs) or compared(pairs, sets))
    rows = []
    for i in range(60):
        words = [f"common{k}" for k in range(30)] + [f"own{i}x{rng.randrange(10**6)}" for _ in range(25)]
        rows.append((i, " ".join(words)))
    found = line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in found} == lines_by_hand(rows)
    joins = [x for x in seen[1]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert len(joins) == 1 and "bit_count" in joins[0] and "key" in joins[0]


def test_kept_lines(spark):
    rows = spark.createDataFrame([(1, "a first line of it\n\nunique", "p"), (2, "a first line of it\nmore here", "q"), (3, None, "r"), (None, "a first line of it", "s")],
                                 "doc_id long, text string, source string")
    kept = line_dedup.keep_first_lines(rows, line_dedup.line_components(rows))
    assert kept.columns == rows.columns
    assert {r.source: r.text for r in kept.collect()} == {"p": "a first line of it\n\nunique", "q": "more here", "r": None, "s": "a first line of it"}


def test_no_lines(docs):
    assert line_dedup.line_components(docs.limit(0)).collect() == []


def test_line_search_runs_no_python(docs):
    plan = line_dedup.line_components(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- units ---------------------------------------------------------------------------------

def test_units(texts):
    rows = sorted({(r.id, r.text) for r in texts.collect()}, key=lambda r: r[0])
    seen, expected = set(), {}
    for i, text in rows:
        units, gone, at = (text.split("\n") if text is not None else []), [], 0
        for k, u in enumerate(units):
            normal = re.sub("[ \t]+", " ", u).strip(" ").translate({c: c + 32 for c in range(65, 91)}).encode()
            if normal.strip(b"\t\n\x0b\x0c\r "):
                if normal in seen:
                    gone.append((k, at, len(u.encode())))
                seen.add(normal)
            at += len(u.encode()) + 1
        kept = "\n".join(u for k, u in enumerate(units) if k not in {g[0] for g in gone}).encode()
        expected[i] = (len((text or "").encode()), len(units), gone, hashlib.sha256(kept).hexdigest())
    found = unit_dedup.cut(texts).collect()
    assert len(found) == texts.count()
    assert {r.id: (r.n_bytes, r.n_units, [tuple(x) for x in r.removed], r.kept_sha256) for r in found} == expected


def test_short_units(spark):
    rows = [(1, "a\n漢字仮名交じ\n\n"), (2, "A \n漢字仮名交じ\n\r\n\nb"), (3, "b\n\r")]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r.n_removed for r in unit_dedup.cut(docs, least=20).collect()} == {0}
    found = unit_dedup.cut(docs).collect()
    assert {r.id: bytes(r.kept).decode() for r in found} == {1: "a\n漢字仮名交じ\n\n", 2: "\r\n\nb", 3: "\r"}


def test_no_units(texts):
    assert unit_dedup.cut(texts.limit(0)).collect() == []


# --- byte strings --------------------------------------------------------------------------

def cut_by_hand(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_byte_strings(texts):
    rows = {(r.id, r.text) for r in texts.collect()}
    found = suffix_dedup.cut(texts).collect()
    assert len(found) == texts.count()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == cut_by_hand(rows, 100)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_byte_strings_of_few_letters(spark, seed):
    """Short strings over two letters: nested, overlapping and periodic repeats."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) + "abc" * rng.randrange(0, 12)) for i in range(60)]
    found = suffix_dedup.cut(spark.createDataFrame(rows, "id long, text string"), length=10, gram=4).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == cut_by_hand(rows, 10)


def test_kept_bytes_and_offsets_give_the_text_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    text = {r.id: r.text.encode() for r in docs.collect()}
    for r in suffix_dedup.cut(docs).collect():
        whole, at = b"", 0
        kept = bytes(r.kept)
        for s in r.spans:
            n = s.start - len(whole)
            whole += kept[at:at + n] + text[r.id][s.start:s.end]
            at += n
        assert whole + kept[at:] == text[r.id]


def test_maximal_repeats_name_all_occurrences():
    groups = list(suffix_dedup.repeat_groups([(b"xx", b"abcdefgh"), (b"xy", b"abcdefzz"), (b"xx", b"abcdefgi")], 6, 4))
    assert sorted((sorted(m), left, right) for m, left, right in groups) == [([0, 1, 2], 1, 6), ([0, 2], 2, 7)]


def test_intervals_are_the_common_prefix_tree():
    assert sorted(suffix_dedup.intervals([3, 5, 3, 1, 4], 2)) == [(0, 3, 3), (1, 2, 5), (4, 5, 4)]


def test_no_byte_strings(texts):
    assert suffix_dedup.cut(texts.limit(0)).collect() == []


# --- embeddings ----------------------------------------------------------------------------

def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16))
    rows = [(i, i % 3, (centres[i % 4] + rng.normal(scale=0.17, size=16)).tolist()) for i in range(160)]
    rows += [(200 + i, 0, rows[0][2]) for i in range(5)] + [(300, 0, [2 * x for x in rows[0][2]])]
    odd = [(400, None, rows[0][2]), (401, 0, None), (402, 0, []), (403, 0, [0.0] * 16), (404, 0, [float("nan")] + [1.0] * 15),
           (405, 0, [float("inf")] * 16), (406, 0, [None] + [1.0] * 15), (407, 0, [1.0, 2.0]), (408, 0, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "id long, label int, vector array<double>").withColumn("width", F.lit("x"))
    found = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table, tile=16).collect()}
    usable = [(i, (lab, len(v)), np.array(v)) for i, lab, v in rows + odd[-2:]]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a[0], b[0]) for k, a in enumerate(usable) for b in usable[:k] if a[1] == b[1] and cos(a[2], b[2]) >= 0.93]
    root = roots([i for i, *_ in rows + odd], links)
    number = {i: sum(i in x for x in links) for i in root}
    assert found == {i: (number[i], root[i]) for i in root}
    assert 0 < len(links) < len(usable) ** 2 / 4


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    full = rng.normal(size=(60, 48)) * rng.lognormal(size=(60, 1), sigma=4)
    q, scale, error = embedding_dedup.quantised(full)
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    back = q * scale[:, None]
    size = np.linalg.norm(back, axis=1)
    bound = error[:, None] * size + size[:, None] * error + error[:, None] * error
    assert (np.abs(unit @ unit.T - back @ back.T) <= bound + 1e-12).all()
    tile = {"q": q, "scale": scale, "error": error, "full": full}
    row, col, computed = embedding_dedup.linked_pairs(tile, tile, True, 0.3)
    cos = unit @ unit.T
    assert set(zip(row.tolist(), col.tolist())) == {(a, b) for a in range(60) for b in range(a + 1, 60) if cos[a, b] >= 0.3}
    assert computed < 60 * 59 / 4


def test_vectors_of_extreme_lengths(spark):
    """Squares that overflow or vanish lose no link."""
    one = [1.0, 2.0, 3.0, 0.5]
    rows = [(k, 0, [x * s for x in one[:-1]] + [0.5 * s * (1 + k / 50)]) for k, s in enumerate((1.0, 1e200, 1e-200, 1e308 / 3, 5e-300))] + [(9, 0, [-1e200, 1.0, 1.0, 1.0])]
    found = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "id long, label int, vector array<double>")).collect()}
    assert found == {**{k: (4, 0) for k in range(5)}, 9: (0, 9)}


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "id long, label int, vector array<float>")).collect() == []


def test_low_bits_of_pairs_at_the_threshold(spark):
    """Pairs of sets at a similarity of 0.8: none in ten thousand falls below the least number of equal low bits."""
    rng = np.random.default_rng(8)
    n, lost = 400, 0
    for _ in range(10_000):
        shared, own = rng.integers(-2**63, 2**63, n * 8 // 10), rng.integers(-2**63, 2**63, (2, n // 10))
        symbols = []
        for k in range(2):
            h = np.sort(np.concatenate([shared, own[k]]))
            starts = np.arange(line_dedup.BINS, dtype=np.float64) * 2.0**57 - 2.0**63
            symbols.append(h[np.searchsorted(h.astype(np.float64), starts, "left") % len(h)] & 1)
        lost += (symbols[0] == symbols[1]).sum() < line_dedup.LEAST_BITS
    assert lost <= 1
    bits = spark.range(1).selectExpr(f"{line_dedup._low_bits('transform(sequence(0, 127), i -> CAST(i * i AS LONG))')} AS b").first()["b"]
    assert "".join(format(x & (2**64 - 1), "064b") for x in bits) == "".join(str(i * i & 1) for i in range(128))
