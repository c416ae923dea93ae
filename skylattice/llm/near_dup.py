"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search.

A document's signature is ``HASHES`` symbols of 8 bits. Two documents of similarity s differ in about
``HASHES * (1 - s)`` symbols; ``reach`` picks the distance that all but one in a thousand pairs at the
threshold stay within. The symbols are split into so many chunks that two signatures within that distance
differ in at most one symbol of some chunk (pigeonhole); each chunk is looked up once for each place its
one error may take. So every pair within the distance shares a key.

Documents of equal sets are folded before any pair is formed. A bucket's members are first compared with
its hub, the member that shares most keys with others; links are then closed by union-find, and only pairs
of one bucket that are still in different components are compared. Members that resemble their hub keep
the difference of their set from the hub's, which is short; from two such differences the similarity of
their owners follows exactly, so a large group of near copies is settled in tiles of its differences, with
no row for a pair but the linked ones. Pairs with a member unlike the hub are compared by signature and text.
Links are confirmed on the full sets, as integers.

Defined results: a null or wordless text has an empty set and no links; texts with fewer words than a
shingle have one shingle, the whole sequence. Rows with a null ``id`` are left out; rows repeating an id are
folded when their sets are equal. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.common import components, small_batches, staged
from skylattice.llm.text import WordHashes, mix, shingle_set, space_words

HASHES = 64
#: Share of the pairs exactly at the threshold whose signatures may lie beyond the search distance.
MISSES = 1e-3
_BLOCK = 4096
#: Signature distance up to which a member is compared with its hub in full, and keeps its difference.
ALIKE = 40
#: Queries and members of one tile of a hub's group.
TILE = 2048


def reach(percent: int) -> int:
    """Least signature distance that a pair at the threshold exceeds with probability below MISSES."""
    p, left = 1 - percent / 100, 1.0
    for d in range(HASHES + 1):
        left -= math.comb(HASHES, d) * p**d * (1 - p) ** (HASHES - d)
        if left < MISSES:
            return d
    return HASHES


def chunks(distance: int) -> list[np.ndarray]:
    """Symbol numbers by chunk; two signatures within ``distance`` differ at most once in some chunk."""
    return np.array_split(np.arange(HASHES), distance // 2 + 1)


_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_A, _B = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES symbols: the low bytes of the least hash under each of HASHES functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        block = shingles[i:i + _BLOCK, None] * _A + _B
        np.minimum(least, block.min(axis=0), out=least)
    return (mix(least) & np.uint64(255)).astype(np.uint8)


def lookup_keys(signatures: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit keys per signature: each chunk with each of its symbols left out."""
    spread = mix(signatures.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(8)) + np.uint64(1))
    keys = []
    for number, part in enumerate(parts):
        whole = spread[:, part].sum(axis=1)
        for left_out in part:
            keys.append(mix(whole - spread[:, left_out] + mix(np.array([number * HASHES + left_out + 1], np.uint64))))
    return np.stack(keys, axis=1).view(np.int64)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked from ``percent`` hundredths of Jaccard similarity on."""

    words: int = 5
    percent: int = 80

    def sets_of(self, hashes: WordHashes, text: bytes | None) -> np.ndarray:
        return shingle_set(space_words(text), self.words, hashes)

    def enough(self, a, b, differ):
        """Whether sets of so many elements, so many of them in one set only, are linked; in whole numbers."""
        return (100 * (a + b - differ) >= self.percent * (a + b + differ)) & (a + b > differ)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        return bool(self.enough(len(a), len(b), len(np.setxor1d(a, b, assume_unique=True))))


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """``id, n_shingles, digest`` of the set, ``sig`` and its lookup ``keys``, for each row."""
    parts = chunks(reach(rule.percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [rule.sets_of(hashes, t) for t in batch.column(1).to_pylist()]
            filled = [i for i, s in enumerate(sets) if len(s)]
            keys, sigs = [None] * len(sets), [None] * len(sets)
            if filled:
                found = np.stack([signature(sets[i]) for i in filled])
                for i, s, k in zip(filled, found, lookup_keys(found, parts)):
                    keys[i], sigs[i] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "digest", "sig", "keys"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).where("id IS NOT NULL").mapInArrow(
        run, "id long, n_shingles long, digest binary, sig binary, keys array<long>")


def _close(pairs: DataFrame, sigs: DataFrame, distance: int) -> DataFrame:
    """The pairs whose signatures lie within a distance."""
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            near = (x != y).sum(axis=1) <= distance
            yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, linked`` by the full sets, with the size of a's set and its difference from b's."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            known: dict[int, np.ndarray] = {}

            def of(i: int, text: bytes) -> np.ndarray:
                if i not in known:
                    known[i] = rule.sets_of(hashes, text)
                return known[i]

            linked, size, apart = [], [], []
            for i, j, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = of(i, s.as_py()), of(j, t.as_py())
                differ = np.setxor1d(x, y, assume_unique=True)
                linked.append(rule.enough(len(x), len(y), len(differ)))
                size.append(len(x))
                apart.append(differ.tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(apart, pa.binary())],
                ["a", "b", "linked", "size", "apart"])

    wide = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(run, "a long, b long, linked boolean, size long, apart binary")


def _tile_links(rows: list[tuple], rule: Rule) -> Iterator[tuple[int, int]]:
    """Links between queries and members of one tile: ``(query, id, root, size, apart)`` each."""
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    # Two sets differ where exactly one of them differs from the hub's.
    gathered: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        if not rows[k][0]:
            for x in s.tolist():
                gathered.setdefault(x, []).append(k)
    owners = {x: np.array(k) for x, k in gathered.items()}
    plain = np.array([k for k, r in enumerate(rows) if not r[0]], np.int64)
    sizes, roots = np.array([r[3] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    longs = np.array([len(s) for s in sets], np.int64)
    for k, row in enumerate(rows):
        if not row[0]:
            continue
        shared = np.zeros(len(rows), np.int64)
        for x in sets[k].tolist():
            if x in owners:
                shared[owners[x]] += 1
        differ = longs[k] + longs[plain] - 2 * shared[plain]
        good = rule.enough(sizes[k], sizes[plain], differ) & (roots[plain] != row[2])
        for m in plain[good].tolist():
            yield row[1], rows[m][1]


def _linked_in_tiles(members: DataFrame, rule: Rule) -> DataFrame:
    """Links ``u, v`` among ``members (hub, id, root, size, apart)`` of one hub with different roots.

    The members outside the hub's own component are the queries; queries and members are dealt to tiles, and
    each tile of queries meets each tile of members in a task of bounded size.
    """
    own = members.where("id = hub").select("hub", F.col("root").alias("hub_root"))
    told = members.join(own, "hub").withColumn("query", F.col("root") != F.col("hub_root"))
    sizes = told.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).where("q > 0")
    tiles = sizes.select("hub", F.ceil(F.col("n") / TILE).alias("tiles"), F.ceil(F.col("q") / TILE).alias("query_tiles"))
    dealt = told.join(tiles, "hub")
    row = ["hub", "id", "root", "size", "apart"]
    plain = dealt.select(*row, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_tiles") - 1)).alias("i"),
                         F.pmod(F.xxhash64("id", F.lit(1)), "tiles").alias("j"))
    asked = dealt.where("query").select(*row, "query", F.pmod(F.xxhash64("id", F.lit(2)), "query_tiles").alias("i"),
                                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for tile, row in zip(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))), zip(*(batch.column(k).to_pylist() for k in range(3, 8)))):
                if tile != now:
                    out.extend(_tile_links(rows, rule))
                    now, rows = tile, []
                rows.append(row)
            yield links(out)
        yield links(list(_tile_links(rows, rule)))

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = plain.unionByName(asked).select("hub", "i", "j", "query", "id", "root", "size", "apart")
    return spread.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``id, n_shingles, component_id`` per row of ``docs (id, text)``; see the module for the rules."""
    small_batches(docs.sparkSession)
    distance = reach(rule.percent)
    marks = staged(signatures(docs, rule))
    # Rows of one set, and rows that repeat an id, meet in one class; its least id speaks for it.
    filled = marks.where("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("id").alias("rep"))
    own = F.col("id") == F.col("rep")
    member = staged(filled.select("id", "n_shingles", "digest", "keys", "sig").join(classes, "digest").select(
        "id", "rep", F.col("n_shingles").alias("size"), F.when(own, F.col("keys")).alias("keys"), F.when(own, F.col("sig")).alias("sig")))
    reps = member.where("keys IS NOT NULL").select("id", "size", "sig").dropDuplicates(["id"])
    keys = member.where("keys IS NOT NULL").select("id", F.explode("keys").alias("key"))

    crowds = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    live = staged(keys.join(crowds.select("key", "n"), "key"))
    weight = live.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = live.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    spots = staged(live.select("key", "id").join(hubs, "key"))
    star = staged(spots.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = live.select("id").distinct()
    texts = staged(docs.select("id", F.col("text").cast("binary").alias("text")).join(wanted, "id", "left_semi")
                   .dropDuplicates(["id"]))
    sigs = staged(reps.join(wanted, "id", "left_semi"))
    same_row = member.where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    compared = staged(_compared(_close(star, sigs, max(distance, ALIKE)), texts, rule))
    links = compared.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))

    # What the stars left apart: pairs of one bucket in different components.
    root = staged(components(links)).withColumnRenamed("node", "id")
    rooted = sigs.select("id", "size").join(root, "id", "left").select("id", "size", F.coalesce("root", "id").alias("root"))
    told = compared.select(F.col("b").alias("hub"), F.col("a").alias("id"), "apart")
    centres = told.select("hub").distinct().select("hub", F.col("hub").alias("id"), F.lit(b"").alias("apart"))
    inner = _linked_in_tiles(staged(told.unionByName(centres).join(rooted, "id")), rule)
    # A bucket all of whose members resemble the hub is settled by now.
    known = told.unionByName(centres).select("hub", "id", F.lit(True).alias("told"))
    placed = staged(spots.join(known, ["hub", "id"], "left").join(rooted, "id").select(
        "key", "id", "root", "size", (F.coalesce("told", F.lit(False)) | (F.col("id") == F.col("hub"))).alias("told")))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("told").alias("all")).where(
        "lo < hi AND NOT all").select("key")
    open_ = placed.join(apart, "key")
    other = open_.select("key", F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("told").alias("told_b"))
    alike = 100 * F.least("size", "size_b") >= rule.percent * F.greatest("size", "size_b")
    rest = open_.join(other, "key").where((F.col("root") < F.col("root_b")) & alike & ~(F.col("told") & F.col("told_b")))
    rest = rest.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    more = _compared(_close(rest, sigs, distance), texts, rule).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))

    root = components(links.unionByName(inner).unionByName(more).unionByName(same_row))
    found = root.withColumnRenamed("node", "id").withColumnRenamed("root", "component_id")
    return marks.select("id", "n_shingles").join(found, "id", "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
