"""Repair of conversations against all edit strings of short ones and against a plain reading of the rules."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skylattice.llm import conversation, queries

SF = "/root/testdata/sf0.01"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_by_hand(rows):
    seen, found = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def repair_by_hand(rows, inserts=3):
    """All strings of edits with bounded inserts, each applied and judged."""
    faults = faults_by_hand(rows)
    best = None

    def grow(k, left, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            initials = "".join(r[:1] for r, _ in out)
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(out))
        if left:
            for role in ("user", "assistant"):
                grow(k, left - 1, cost + 5, audit + "I", out + [(role, "")])
        if k < len(rows):
            (role, text), fault = rows[k], faults[k]
            grow(k + 1, left, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role:
                    grow(k + 1, left, cost + more, audit + "K", out + [(role, text)])
                for given in ("user", "assistant"):
                    grow(k + 1, left, cost + 1 + more, audit + "R", out + [(given, text)])

    grow(0, inserts, 0, "", [])
    return best


def run(rows):
    audit, out = [], []

    def emit(edit, role, text):
        audit.append(edit)
        if edit != "D":
            out.append((role, text))

    search = conversation.Search(emit)
    for (role, text), fault in zip(rows, faults_by_hand(rows)):
        search.push(role, text, fault)
    return search.finish(), "".join(audit), out


def test_search_equals_all_edit_strings():
    rng = random.Random(2)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["a.", "b!", "cut", " ", f"x{rng.randrange(9)}?"]))
                for _ in range(rng.randrange(6))]
        cost, audit, out = run(rows)
        assert (cost, audit, out) == repair_by_hand(rows), rows


def test_search_holds_unresolved_rows_only():
    search = conversation.Search(lambda *_: None)
    most = 0
    for k in range(20_000):
        search.push("user" if k % 2 == 0 else "assistant", f"text {k}.", None)
        most = max(most, search.unresolved)
    assert search.finish() == 0 and most < 10


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def report_by_hand(rows):
    """The contract of the query for (turn, role, text) rows in order."""
    turns = [t for t, *_ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    faults = faults_by_hand(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, out = run(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest(out))


def test_query_on_damaged_conversations(spark):
    by_conv = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        found = by_conv.setdefault(r.conv_id, [])
        draw = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", r.text) if draw == 2 else r.text
        found += [(r.turn, "user" if draw == 4 else r.role, text)] * {0: 0, 3: 2}.get(draw, 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == {c: report_by_hand(sorted(rows, key=lambda r: r[0])) for c, rows in by_conv.items()}
    assert {e for g in got.values() for e in g[6]} == set("DKR")


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (1, None, None, None), (1, None, "user", "x."), (2, 5, "", "no role."),
            (2, 9, "user", "a" * 200_000 + "."), (2, 9, "user", "a" * 200_000 + "."), (2, 12, "assistant", "é漢."), (3, 0, "system", "only."),
            (4, -2, "tool", "t."), (4, 3, "user", "cut")]
    table = spark.createDataFrame(rows, "conv long, turn int, role string, text string").withColumn("kind", F.lit("x")).withColumn("digest", F.lit(1))
    got = {r.conv: tuple(r)[1:] for r in conversation.report(table).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    assert got == {c: report_by_hand(sorted(g, key=key)) for c, g in groups.items()}
    assert got[2][0] == 5 and got[3][5:7] == (2, "D")
    told = {}
    for r in conversation.repaired(table).orderBy("place").collect():
        told.setdefault(r.conv, []).append((r.role, r.text))
    assert all(digest(told.get(c, [])) == g[7] for c, g in got.items())
    assert conversation.report(table.limit(0)).collect() == [] and conversation.repaired(table.limit(0)).collect() == []


def test_conversation_without_rows(spark):
    rows = spark.createDataFrame([("a", 1, "user", "x.", False)], "conv string, turn long, role string, text string, here boolean")
    assert tuple(conversation.report(rows).first()) == ("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("draw", range(5))
def test_damage(spark, draw):
    turn = next(t for t in range(500) if zlib.crc32(f" :{t}".encode()) % 20 == draw)
    rows = spark.createDataFrame([(None, turn, None, "a.b!c?")], "conv long, turn long, role string, text string")
    got = [tuple(r)[2:] for r in conversation.damaged(rows).collect()]
    expected = {0: [(" ", "a.b!c?", False)], 1: [(" ", "", True)], 2: [(" ", "abc", True)], 3: [(" ", "a.b!c?", True)] * 2, 4: [("user", "a.b!c?", True)]}
    assert got == expected[draw]
