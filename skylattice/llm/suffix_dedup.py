"""Repeated byte strings: common-prefix interval trees over enhanced suffix arrays, spread by anchors.

A string of ``LENGTH`` bytes is found through its anchor: of the ``GRAM``-byte strings in it, the one of
least hash, the leftmost if several are equal. Equal strings have equal anchors at equal places, so all
occurrences of a string meet under one key, whichever documents they lie in. The strings of one anchor
occurrence follow one another; the bytes they span are its context.

Anchors whose hash occurs once in the corpus are dropped after a grouped count. The others send their
contexts to a task by key. There the suffixes that start at the anchor are sorted, with the lengths of
their common prefixes (the enhanced suffix array), and a stack scan visits the tree of common-prefix
intervals from the leaves up. In each interval the bytes before the anchor, read backwards, are scanned the
same way: where they differ, the left extension is diverse, and the members up to there form a maximal
repeat group with all its occurrences. Equal contexts are folded first, so a task holds the different
contexts of one anchor, never all its occurrences, and the tree of a thousand copies is one leaf.

Defined results: a null text is empty; matches never cross documents; of equal texts only the one of least
id is searched, the others are repeats as a whole. Rows that repeat an id get one result if their texts are
equal; if their texts differ they are judged as separate documents, the order between them being that of
their texts' digests. Rows with a null id, and columns other than id and text, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skylattice.llm.common import small_batches
from skylattice.llm.text import mix

LENGTH = 100
#: A power of two, well below LENGTH: longer ones repeat less by chance, shorter ones give fewer anchors.
GRAM = 32
_SEGMENT = 1 << 18
_PLACE = np.uint64(20)

#: One anchor occurrence: where it starts, and how far its strings reach to the left and right of that.
Anchor = tuple[int, int, int]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, reach to the left and reach to the right of each anchor of a text."""
    found = []
    for at in range(0, max(0, len(text) - length + 1), _SEGMENT):
        h = np.frombuffer(text[at:at + _SEGMENT + length - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        step = 1
        while step < gram:
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + mix(h[step:]) if step == 1 else \
                h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
            step *= 2
        h = mix(h)
        least = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[:have - width], least[width - have:])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        found.append((h[place].view(np.int64), place + at, place - first, last + length - place))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(first, last, length)`` of length ``least`` and more, children first.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1. One scan with a stack of open intervals.
    """
    open_: list[tuple[int, int]] = []
    for i, length in enumerate([*lcp, -1]):
        first = i
        while open_ and open_[-1][1] > length:
            first, of = open_.pop()
            yield first, i, of
        if length >= least and (not open_ or open_[-1][1] < length):
            open_.append((first, length))


def repeat_groups(contexts: list[tuple[bytes, bytes]], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[list[int], int, int]]:
    """Maximal repeat groups among different contexts: member numbers, reach to the left and to the right.

    A context is ``(bytes before the anchor read backwards, bytes from the anchor on)``.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    right = [common_prefix(contexts[i][1], contexts[j][1]) for i, j in zip(order, order[1:])]
    for first, last, ahead in intervals(right, gram):
        if last - first == 1:
            members = order[first:last + 1]
            behind = common_prefix(contexts[members[0]][0], contexts[members[1]][0])
            if ahead + behind >= length:
                yield members, behind, ahead
            continue
        ranked = sorted(range(first, last + 1), key=lambda k: contexts[order[k]][0])
        left = [common_prefix(contexts[order[i]][0], contexts[order[j]][0]) for i, j in zip(ranked, ranked[1:])]
        for a, b, behind in intervals(left, max(0, length - ahead)):
            low, high = min(ranked[a:b + 1]), max(ranked[a:b + 1])
            # Members of one child go on together to the right, and belong to its groups.
            if min(right[low:high]) == ahead:
                yield [order[k] for k in ranked[a:b + 1]], behind, ahead


def _groups(seen: dict[tuple[bytes, bytes], list[tuple]], length: int, gram: int) -> Iterator[tuple[list[tuple], int, int]]:
    """Occurrences of each repeat under one key, in order, with the reach to the left and right of the anchor."""
    contexts = list(seen)
    for (back, ahead), places in seen.items():
        if len(places) > 1 and len(back) + len(ahead) >= length:
            yield places, len(back), len(ahead)
    if len(contexts) > 1:
        for members, behind, ahead in repeat_groups(contexts, length, gram):
            yield sorted(p for m in members for p in seen[contexts[m]]), behind, ahead


def _contexts(docs: DataFrame, length: int, gram: int, copies: DataFrame | None) -> DataFrame:
    """Contexts of the anchors that occur more than once: ``key, id, digest, start, back, ahead, run``.

    Rows of ``copies (id, digest)`` send none.

    A context that a document has before is no context but a repeat at once: ``back`` is null, and it
    starts at ``start`` and runs for ``run`` bytes.
    """
    number = docs.schema["id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, many, rows = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                kinds, times = np.unique(anchors(text, length, gram)[0], return_counts=True)
                keys.append(kinds), many.append(times > 1), rows.append(np.full(len(kinds), i))
            if rows:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(np.concatenate(many)), batch.column(0).take(rows),
                    batch.column(1).take(rows)], ["key", "many", "id", "digest"])

    found = docs.select("id", "digest", "text").mapInArrow(hashes, f"key long, many boolean, id {number}, digest long")
    # One exchange: the rows of a hot key stream through its task, sorted and spilled. Copies of one text
    # alone make no anchor repeat.
    same = Window.partitionBy("key")
    again = (F.min("digest").over(same) != F.max("digest").over(same)) | F.max("many").over(same)
    wanted = found.withColumn("again", again).where("again").groupBy("id", "digest").agg(F.collect_list("key").alias("keys"))
    if copies is not None:
        wanted = wanted.join(copies, ["id", "digest"], "left_anti")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            rows = []
            for i, (text, keys) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                key, start, left, right = anchors(text, length, gram)
                mine = np.flatnonzero(np.isin(key, keys.values.to_numpy()))
                before: set[bytes] = set()
                spans: list[tuple[int, int]] = []
                for k, s, l, r in zip(key[mine].tolist(), start[mine].tolist(), left[mine].tolist(), right[mine].tolist()):
                    whole = text[s - l:s + r]
                    if whole not in before:
                        before.add(whole)
                        for column, value in zip(out, (k, s, whole[:l][::-1], whole[l:], None)):
                            column.append(value)
                        rows.append(i)
                    elif spans and s - l <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], s + r))
                    else:
                        spans.append((s - l, s + r))
                # Runs of them are joined; they only pass through the next step, under any key.
                for first, last in spans:
                    for column, value in zip(out, (hash((batch.column(1)[i].as_py(), first)), first, None, None, last - first)):
                        column.append(value)
                    rows.append(i)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows),
                pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())],
                ["key", "id", "digest", "start", "back", "ahead", "run"])

    return docs.join(wanted, ["id", "digest"]).select("id", "digest", "text", "keys").mapInArrow(
        contexts, f"key long, id {number}, digest long, start long, back binary, ahead binary, run long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, all_occurrences: bool = True,
            copies: DataFrame | None = None) -> DataFrame:
    """Occurrences of repeats in ``docs (id, digest, text)``: ``group, id, digest, start, length, first``.

    Groups are maximal within the reach of their anchor: a longer repeat shows as overlapping groups, one
    for each of its anchors. Without ``all_occurrences`` each group's first one is left out. Texts are to be
    distinct, or all but one of each named in ``copies (id, digest)``, which are not searched.
    """
    small_batches(docs.sparkSession)
    number = docs.schema["id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, group, before = None, {}, 0, None
        out: list[tuple] = []

        def close() -> None:
            nonlocal group
            for places, behind, ahead in _groups(seen, length, gram):
                group += 1
                for k, (i, d, s) in enumerate(places):
                    if k or all_occurrences:
                        out.append((f"{now}:{group}", i, d, s - behind, behind + ahead, k == 0))
            seen.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(columns, (pa.string(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                ["group", "id", "digest", "start", "length", "first"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(1).type
            for key, i, d, s, back, ahead, run_ in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    close()
                    now, group = key, 0
                if back is None:
                    out.append((None, i, d, s, run_, False))
                    continue
                # The same place of a repeated row comes once.
                if (key, i, d, s) == before:
                    continue
                before = (key, i, d, s)
                places = seen.setdefault((back, ahead), [])
                if places and not all_occurrences:
                    # Later equal contexts are repeats as a whole; the first one speaks for them in the tree.
                    out.append((None, i, d, s - len(back), len(back) + len(ahead), False))
                else:
                    places.append((i, d, s))
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    spread = _contexts(docs, length, gram, copies).repartition(parts, "key").sortWithinPartitions("key", "id", "digest", "start")
    return spread.mapInArrow(run, f"group string, id {number}, digest long, start long, length long, first boolean")


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` per row of ``docs (id, text)``.

    Each byte of a ``length``-byte string that also starts earlier, in a document of smaller id or earlier
    in the same one, is removed. ``spans`` holds the removed runs as offsets into the whole text, ``kept``
    the remaining bytes end to end.
    """
    rows = docs.where("id IS NOT NULL").select(
        "id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    number = rows.schema["id"].dataType.simpleString()
    # Equal texts: the class is told by length and two digests, its first member searched.
    kinds = rows.select("id", "digest", F.unhex(F.sha2("text", 256)).alias("sha"))
    first = kinds.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    copies = kinds.join(first, "sha").where("id > first").select("id", "digest").distinct()
    spans = repeats(rows, length, gram, all_occurrences=False, copies=copies)
    spans = spans.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "length")).alias("found"))
    marks = spans.join(copies.withColumn("copy", F.lit(True)), ["id", "digest"], "full_outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, found, copy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                edge = np.zeros(len(text) + 1, np.int64)
                if copy and len(text) >= length:
                    edge[0] += 1
                    edge[-1] -= 1
                if found.is_valid and len(found.values):
                    start, many = (found.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + many, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).reshape(-1, 2)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(turn) else text
                for column, value in zip(out, (len(text), int(gone.sum()), len(turn), hashlib.sha256(kept).hexdigest(),
                                               [{"start": a, "end": b} for a, b in turn.tolist()], kept)):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(
                pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.join(marks, ["id", "digest"], "left").select("id", "text", "found", "copy").mapInArrow(
        run, f"id {number}, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
             " spans array<struct<start: long, end: long>>, kept binary")
