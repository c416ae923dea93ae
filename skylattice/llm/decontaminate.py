"""Benchmark decontamination: shard suffix arrays searched by every suffix of the test items.

Each Arrow batch of training texts is a shard. Its suffix array holds the word positions that can start a
match: those from which at least as many words in a row are words of some item as the shortest window
asks. Every suffix of every item is looked up by binary search in each shard; hits that continue one
another are joined to the longest verbatim matches, with their place in the document and in the item.

Items travel to the tasks in slices of at most ``SLICE_BYTES`` of text (a single longer item is a slice of
its own size); more slices mean more passes, so the broadcast does not grow with the benchmark.

Defined results: a null text has no words; an item of fewer words than a window is one window, an item
without words none; repeated rows and ids are judged row by row; an empty table gives an empty table.
Other columns of the documents pass through; names of the result that they have already are replaced. Items
without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skylattice.llm.common import small_batches

SLICE_BYTES = 8 << 20
WINDOW = 10

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SPANS = "array<struct<start: long, length: long>>"
_MATCHES = "array<struct<item: string, item_start: long, start: long, length: long>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and bytes above 0x7F."""
    return text.translate(_TABLE).split() if text else []


class Items:
    """One slice of test items: word numbers, and the key of every suffix that starts a window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window, self.vocabulary, keys, tops = window, {}, [], []
        self.item, self.offset, self.width, self.names = [], [], [], []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            self.names.append(name)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            width = min(window, len(ids))
            for j in range(len(ids) - width + 1):
                key = np.zeros(window, ">u4")
                key[:width] = ids[j:j + width]
                top = np.full(window, 0xFFFFFFFF, ">u4")
                top[:width] = ids[j:j + width]
                keys.append(key.tobytes())
                tops.append(top.tobytes())
                self.item.append(len(self.names) - 1)
                self.offset.append(j)
                self.width.append(width)
        kind = f"S{4 * window}"
        self.keys, self.tops = np.array(keys, kind), np.array(tops, kind)
        self.item, self.offset, self.width = (np.array(x, np.int64) for x in (self.item, self.offset, self.width))
        self.shortest = int(self.width.min()) if len(keys) else 0


def _suffix_array(ids: np.ndarray, shortest: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that can start a match, in the order of the words that follow, and those words as keys."""
    n = len(ids)
    stop = np.where(ids == 0, np.arange(n), n)
    ahead = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
    places = np.flatnonzero(ahead >= shortest)
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    rows = np.empty((len(places), window), ">u4")
    for k in range(window):
        rows[:, k] = np.where(ahead[places] > k, padded[places + k], 0)
    keys = rows.view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def _matches(ids: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches: item number, start in the item, start in ``ids``, number of words."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if not len(items.keys) or not len(ids):
        return none
    places, keys = _suffix_array(ids, items.shortest, items.window)
    if not len(places):
        return none
    low, high = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.tops, "right")
    many = high - low
    suffix = np.repeat(np.arange(len(many)), many)
    if not len(suffix):
        return none
    rank = np.arange(len(suffix)) - np.repeat(np.cumsum(many) - many, many) + low[suffix]
    place, item, offset, width = places[rank], items.item[suffix], items.offset[suffix], items.width[suffix]
    order = np.lexsort((place, place - offset, item))
    place, item, offset, width = (x[order] for x in (place, item, offset, width))
    first = np.ones(len(place), bool)
    first[1:] = (item[1:] != item[:-1]) | (np.diff(place) != 1) | (np.diff(offset) != 1)
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(place)) - 1
    return item[starts], offset[starts], place[starts], place[last] + width[last] - place[starts]


def _pass(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int) -> DataFrame:
    """``docs`` with ``n_words`` and the matches so far; its columns pass through as they are."""
    names = docs.columns
    text_at, found_at = names.index("text"), names.index("matches")
    sent = docs.sparkSession.sparkContext.broadcast(Items(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        get = test.vocabulary.get
        for batch in batches:
            words = [words_of(t) for t in batch.column(text_at).to_pylist()]
            lengths = np.array([len(w) for w in words], np.int64)
            # One place between two documents holds no word, so that no match crosses it.
            first = np.cumsum(lengths + 1) - lengths - 1
            ids = np.zeros(int((lengths + 1).sum()), np.int64)
            for w, at in zip(words, first):
                ids[at:at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
            item, offset, place, length = _matches(ids, test)
            row = np.searchsorted(first, place, "right") - 1
            found: list[list] = [[] if m is None else list(m) for m in batch.column(found_at).to_pylist()]
            for i, r, o, p, n in zip(item.tolist(), row.tolist(), offset.tolist(), place.tolist(), length.tolist()):
                found[r].append({"item": test.names[i], "item_start": o, "start": p - int(first[r]), "length": n})
            columns = dict(zip(names, batch.columns)) | {
                "n_words": pa.array(lengths), "matches": pa.array(found, batch.schema.field(found_at).type)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema.names)

    schema = StructType([*docs.schema.fields, *([] if "n_words" in names else [StructField("n_words", LongType())])])
    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches`` against ``items (item_id, text)``; other columns pass through."""
    small_batches(docs.sparkSession)
    parts = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL")
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    out = docs.drop("n_words").withColumns({"text": F.col("text").cast("binary"), "matches": F.lit(None).cast(_MATCHES)})
    for k in range(slices):
        part = parts.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
        out = _pass(out, [(r.item, bytes(r.text)) for r in part.collect()], window)
    return out.withColumn("text", F.col("text").cast("string"))


def covered(found: Column | str = "matches") -> Column:
    """Number of words inside any match."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).cast("long").alias("n"),
        F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["n"])


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words, matches, n_hit, items, contaminated``; ``items`` are the ids of the items found."""
    return matches(docs, items, window).withColumns({
        "n_hit": covered(),
        "items": F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))}).withColumn(
        "contaminated", F.col("n_hit") > 0)
