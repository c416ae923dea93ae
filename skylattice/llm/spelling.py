"""Spelling variants: words one letter apart, found by a bit-sliced position index.

Two words are near if exactly one inserted, deleted or replaced character parts them. The index over a part of the
vocabulary is one bitset per position and letter: the words that have that letter there. A query runs through its
letters and keeps two sets of words at once by whole-word logic: those that agree so far without an error, and those
with one. A replaced letter moves words from the first set to the second where the letter's bitset lacks them; an
inserted one carries the second set on with positions shifted by one.

Which words meet in an index: if words of m and m or m + 1 characters are near, they share their first m // 2
characters or their last m // 2. So each word goes to the groups of its beginning and its end, for its own length and
for the one below. A pair is reported by the group of its common beginning if it has one, else by that of its end, so
once. Groups larger than ``TILE`` words are dealt to tiles, in which a block of queries meets a block of the index; a
task holds one tile at a time, however many words share a beginning. Only near pairs leave a tile, and a word
has a bounded number of near words for its length and alphabet.

A word's form is its near word of largest count, ties by code points, if that count is at least ``RATIO`` times the
word's own. Counts rise along forms, so chains have a bounded length, and the last form of each word is
found by doubling: each round joins the links with themselves.

Defined results: a null text has no words, and neither has one without letters of the range. A word is a maximal
run of ``LETTERS``; only A-Z are lower-cased. Repeated rows count each time. Rows with a null id count as
they are. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.common import small_batches, staged

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of one bitset, and queries that meet it in one task.
TILE = 4096


def occurrences(docs: DataFrame) -> DataFrame:
    """``id, word`` for each run of letters of ``docs (id, text)``."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("id", F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("word"))


def misspelt(words: DataFrame, every: int = 199) -> DataFrame:
    """``id, word`` with one character taken out where ``every`` divides the checksum of ``<id>:<word>``."""
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    drawn = words.select("id", "word", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("word")).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return drawn.select("id", F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class BitIndex:
    """Bitsets of words by position and letter."""

    def __init__(self, words: list[str]):
        self.words, self.all = words, (1 << len(words)) - 1
        self.sets: dict[tuple[int, str], int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            for place in enumerate(word):
                self.sets[place] = self.sets.get(place, 0) | bit

    def replaced(self, query: str) -> int:
        """Words of the query's length with exactly one other letter."""
        zero, one = self.all, 0
        for place in enumerate(query):
            has = self.sets.get(place, 0)
            one = one & has | zero & ~has
            zero &= has
            if not (zero or one):
                break
        return one

    def inserted(self, query: str) -> int:
        """Words that have one letter more than the query, anywhere."""
        zero = one = self.all
        for i, letter in enumerate(query):
            zero &= self.sets.get((i, letter), 0)
            one = one & self.sets.get((i + 1, letter), 0) | zero
            if not one:
                break
        return one

    def numbers(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


def _near_in_tile(m: int, at_end: bool, members: list[tuple[str, int]], queries: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
    """``word, near word, its count`` of one tile: queries of m characters, members of m and m + 1."""
    half = m // 2
    for size in (m, m + 1):
        part = [x for x in members if len(x[0]) == size]
        if not part:
            continue
        index = BitIndex([w for w, _ in part])
        for query, n in queries:
            for k in index.numbers(index.replaced(query) if size == m else index.inserted(query)):
                word, count = part[k]
                if at_end and word[:half] == query[:half]:
                    continue  # found by the group of their beginning
                yield query, word, count
                if size > m:
                    yield word, query, n


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, tile: int = TILE) -> DataFrame:
    """``word, near, near_n`` for each near pair of ``words (word, n)``, in both directions.

    ``words`` has distinct words of at least ``least_letters`` characters and is read several times.
    """
    small_batches(words.sparkSession)
    length = F.length("word")
    classes = F.array_distinct(F.array(F.greatest(length - 1, F.lit(least_letters)), length))
    spread = words.select("word", "n", F.explode(classes).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    keys = F.array(F.struct(F.lit(False).alias("at_end"), F.left("word", half).alias("key")), F.struct(F.lit(True).alias("at_end"), F.right("word", half).alias("key")))
    placed = spread.select("word", "n", "m", (length == F.col("m")).alias("asks"), F.explode(keys).alias("g")).select("word", "n", "m", "asks", "g.*")
    group = ["m", "at_end", "key"]
    sizes = placed.groupBy(group).agg(F.count("*").alias("members"), F.count_if("asks").alias("queries")).where("members > 1 AND queries > 0")
    tiles = sizes.select(*group, F.ceil(F.col("members") / tile).cast("int").alias("tiles"), F.ceil(F.col("queries") / tile).cast("int").alias("query_tiles"))
    dealt = placed.join(tiles, group)
    everywhere = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    plain = dealt.select(*group, F.explode(everywhere("query_tiles")).alias("i"), F.pmod(F.xxhash64("word", F.lit(1)), "tiles").cast("int").alias("j"),
                         F.lit(False).alias("query"), "word", "n")
    asked = dealt.where("asks").select(*group, F.pmod(F.xxhash64("word", F.lit(2)), "query_tiles").cast("int").alias("i"), F.explode(everywhere("tiles")).alias("j"),
                                       F.lit(True).alias("query"), "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for here, query, word, n in zip(zip(*columns[:5]), *columns[5:]):
                if here != now:
                    if now is not None:
                        out.extend(_near_in_tile(now[0], now[1], *held))
                    now, held = here, ([], [])
                held[query].append((word, n))
            yield pairs(out)
        if now is not None:
            yield pairs(list(_near_in_tile(now[0], now[1], *held)))

    def pairs(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        word, near, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    tile_of = [*group, "i", "j"]
    return plain.unionByName(asked).repartition(*tile_of).sortWithinPartitions(*tile_of).mapInArrow(run, "word string, near string, near_n long")


def variants(words: DataFrame, least_letters: int = LEAST_LETTERS, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each of ``words (word, n)``; see the module."""
    words = staged(words)
    best = near_words(words, least_letters, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    told = words.join(best, "word", "left")
    follows = F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False))
    table = staged(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.minus")).alias("form_n")))

    links = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Counts grow by the ratio with each form, so no chain is longer than this.
    top, low = table.agg(F.max("n"), F.min("n")).first()
    depth = int(math.log(top / low, ratio) + 1e-9) if top else 0
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = staged(links.join(after, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    return table.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
