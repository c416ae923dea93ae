"""Near-duplicate embeddings: int8 tile products with error bounds, exact cosines where they may matter.

Vectors meet only under equal labels and equal widths. Equal ones are folded first, with their number. The
others are dealt by a hash of the id to tiles of about ``TILE`` vectors; each pair of tiles is one task's
work. A tile's unit vectors are quantised to int8 with a scale and the exact length of the rounding error
for each vector, so ``|<u, v> - s_u s_v <q_u, q_v>| <= e_u |s_v q_v| + |s_u q_u| e_v + e_u e_v`` holds for
every pair. Only pairs whose bound reaches the threshold are computed again, in double precision from the
full vectors. A task gives each vector's number of links and links to the least vector of its component
within the pair of tiles, at most two rows a vector, however many pairs are linked.

Defined results: a vector that is null, empty, zero, or holds a null or a non-finite component, or whose
label is null, links with nothing; rows with a null id are left out; rows that repeat an id are vectors of
one id, and their links are added; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.common import components, staged

TILE = 1024
THRESHOLD = 0.93
#: More than double precision can lose in a product of unit vectors of a few thousand components.
_SLACK = 1e-9
_PAIRS = 1 << 17


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def quantised(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales and the exact lengths of the rounding errors of the unit vectors."""
    largest = np.abs(full).max(axis=1, keepdims=True)
    unit = full / largest
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, error


def _levelled(full: np.ndarray) -> np.ndarray:
    """Vectors with their largest component near one, by exact powers of two: lengths neither overflow nor vanish."""
    return np.ldexp(full, -np.frexp(np.abs(full).max(axis=1, keepdims=True))[1])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def linked_pairs(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the linked pairs of two tiles, and how many pairs were computed in full precision."""
    # Sums of int8 products are whole numbers: exact in single precision up to 2^24, else in double.
    kind = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a["q"].astype(kind) @ b["q"].astype(kind).T).astype(np.float64) * a["scale"][:, None] * b["scale"][None, :]
    long_a, long_b = (np.linalg.norm(t["q"].astype(np.float64), axis=1) * t["scale"] for t in (a, b))
    bound = a["error"][:, None] * (long_b + b["error"])[None, :] + long_a[:, None] * b["error"][None, :] + _SLACK
    maybe = near + bound >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    row, col = np.nonzero(maybe)
    keep = [_cosines(a["full"][row[i:i + _PAIRS]], b["full"][col[i:i + _PAIRS]]) >= threshold for i in range(0, len(row), _PAIRS)]
    keep = np.concatenate(keep) if keep else np.empty(0, bool)
    return row[keep], col[keep], len(row)


def _least_reachable(n: int, row: np.ndarray, col: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Least rank in the component of each of n nodes, by repeated minima over links."""
    least = rank.copy()
    ends = np.concatenate([row, col])
    others = np.concatenate([col, row])
    order = np.argsort(ends, kind="stable")
    ends, others = ends[order], others[order]
    first = np.flatnonzero(np.diff(ends, prepend=-1))
    while True:
        new = least.copy()
        new[ends[first]] = np.minimum(new[ends[first]], np.minimum.reduceat(least[others], first))
        if (new == least).all():
            return least
        least = new


def _tile(row: pd.Series) -> dict:
    n = len(row["scale"]) // 8
    return {
        "ids": np.frombuffer(row["ids"], np.int64), "times": np.frombuffer(row["times"], np.int64),
        "scale": np.frombuffer(row["scale"], np.float64), "error": np.frombuffer(row["error"], np.float64),
        "q": np.frombuffer(row["q"], np.int8).reshape(n, -1), "full": np.frombuffer(row["full"], np.float64).reshape(n, -1)}


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``id, n_links, root`` of each vector of ``vectors (id, label, vector, times)`` linked within some pair of tiles."""
    wide = vectors.withColumn("width", F.size("vector"))
    groups = wide.groupBy("label", "width").agg(F.count("*").alias("n"))
    dealt = wide.join(groups, ["label", "width"]).withColumn("tiles", F.ceil(F.col("n") / tile)).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        full = _levelled(np.stack(rows["vector"].to_numpy()).astype(np.float64))
        q, scale, error = quantised(full)
        one = rows.iloc[0]
        return pd.DataFrame([{
            "label": one["label"], "width": one["width"], "tile": one["tile"], "tiles": one["tiles"],
            "ids": rows["id"].to_numpy(np.int64).tobytes(), "times": rows["times"].to_numpy(np.int64).tobytes(),
            "q": q.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "full": full.tobytes()}])

    label = vectors.schema["label"].dataType.simpleString()
    packed = dealt.groupBy("label", "width", "tile").applyInPandas(
        pack, f"label {label}, width int, tile long, tiles long, ids binary, times binary, q binary, scale binary, error binary, full binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = packed.withColumn("other", other).withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile")
        a, b = _tile(rows.iloc[0]), _tile(rows.iloc[-1])
        same = len(rows) == 1
        if same and rows.iloc[0]["lo"] != rows.iloc[0]["hi"]:
            return pd.DataFrame({"id": [], "n_links": [], "root": []}, dtype=np.int64)
        row, col, _ = linked_pairs(a, b, same, threshold)
        na = len(a["ids"])
        ids, times = (a["ids"], a["times"]) if same else (np.concatenate([a[k], b[k]]) for k in ("ids", "times"))
        col = col if same else col + na
        links = np.bincount(row, times[col], len(ids)) + np.bincount(col, times[row], len(ids))
        some = links > 0
        root = _least_reachable(len(ids), row, col, ids) if len(row) else ids
        return pd.DataFrame({"id": ids[some], "n_links": links[some].astype(np.int64), "root": root[some]})

    parts = met.groupBy("label", "width", "lo", "hi").applyInPandas(meet, "id long, n_links long, root long")
    return parts


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``id, n_links, component_id`` per row of ``vectors (id, label, vector)`` with a long id."""
    rows = vectors.where("id IS NOT NULL").select(
        "id", "label", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    good = rows.where(F.col("label").isNotNull() & _usable(F.col("vector")))
    classes = staged(good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("times")))
    # A vector may stand under several labels or be several vectors of one id: the class is told by a number.
    numbered = classes.select(F.col("rep").alias("id"), "label", "vector", "times")
    met = staged(link_counts(numbered, threshold, tile))
    member = good.join(classes, ["label", "vector"]).select("id", "rep", "times")
    counted = met.groupBy("id").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("id", "rep")
    member = staged(member.join(counted, "rep", "left").select(
        "id", "rep", (F.coalesce("n_links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    edges = met.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(
        member.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    root = components(edges).select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    linked = member.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return rows.select("id").join(linked, "id", "left").join(root, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
