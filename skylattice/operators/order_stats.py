"""Exact order statistics without sorting or gathering the column.

Each pass counts the values of an interval in ``BUCKETS`` equal parts, with the least and greatest value
of each part. The part that holds the wanted rank becomes the next interval, shrunk to the values it really
holds. Least and greatest value never share a part, so every pass makes the interval smaller, until it holds
one value or the rank is at an end of it. A pass is a grouped count: every task sends at most one row per
target and part, whatever its share of the data, and there is no merge in a single task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

BUCKETS = 4096
_MAX = sys.float_info.max
_HALF_MAX = _MAX / 4


@dataclass
class _Target:
    column: str
    rank: int
    integral: bool
    #: Where the wanted value lies: its bounds, which are values of the column, and its rank among them.
    low: float | int | None = None
    high: float | int | None = None
    inside: int = 0
    value: float | int | None = None

    def bucket(self) -> Column:
        """Part of the interval, for values inside it."""
        c = F.col(self.column)
        if self.integral:
            # whole numbers all the way: neighbours beyond 53 bits are told apart
            step = (self.high - self.low) // BUCKETS + 1
            part = F.expr(f"(cast(`{self.column}` AS decimal(20,0)) - cast('{self.low}' AS decimal(20,0))) div cast('{step}' AS decimal(20,0))")
        else:
            low, high = (max(-_MAX, min(_MAX, v)) for v in (self.low, self.high))
            scale = 0.25 if max(abs(low), abs(high)) > _HALF_MAX else 1.0
            near = F.greatest(F.lit(-_MAX), F.least(F.lit(_MAX), c))
            part = F.floor((near * scale - F.lit(low * scale)) / F.lit(high * scale - low * scale) * BUCKETS)
        inside = (c >= F.lit(self.low)) & (c <= F.lit(self.high))
        return F.when(inside, F.least(F.lit(BUCKETS - 1), part.cast("int")))


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, list]:
    """Values at zero-based ranks of numeric columns; NULL and NaN are not counted.

    All columns and ranks share the passes over ``df``.
    """
    kinds = {c: isinstance(df.schema[c].dataType, IntegralType) for c in ranks}
    df = df.select(*[_clean(df, c).cast("bigint" if kinds[c] else "double").alias(c) for c in ranks])
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(ranks) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    targets = []
    for i, (column, wanted) in enumerate(ranks.items()):
        for rank in wanted:
            if not 0 <= rank < ends[f"n{i}"]:
                raise ValueError(f"rank {rank} outside the {ends[f'n{i}']} values of {column}")
            targets.append(_Target(column, rank, kinds[column], ends[f"lo{i}"], ends[f"hi{i}"], ends[f"n{i}"]))
    wanted = {id(t): t.rank for t in targets}
    while open_ := [t for t in targets if not _settled(t, wanted)]:
        _narrow(df, open_, wanted)
    result: dict[str, list] = {c: [] for c in ranks}
    for t in targets:
        result[t.column].append(t.value)
    return result


def _settled(t: _Target, wanted: dict[int, int]) -> bool:
    """Whether the interval tells the value: its only one, its least or its greatest."""
    rank = wanted[id(t)]
    if t.low == t.high or rank == 0:
        t.value = t.low
    elif (t.low, t.high) in ((_MAX, math.inf), (-math.inf, -_MAX)):
        # the last finite number and infinity share a part: so many of the one, then the other
        raise ValueError(f"{t.column} holds infinities beside the largest numbers")
    elif rank == t.inside - 1:
        t.value = t.high
    return t.value is not None


def present_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(_clean(df, c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def medians(df: DataFrame, columns: Sequence[str], counts: Mapping[str, int] | None = None) -> dict[str, float | None]:
    """Exact medians, the mean of the two middle values for an even count.

    ``counts`` are the numbers of present values, if they are known already.
    """
    if counts is None:
        counts = present_counts(df, columns)
    ranks = {c: sorted({(counts[c] - 1) // 2, counts[c] // 2}) for c in columns if counts[c]}
    found = order_statistics(df, ranks) if ranks else {}
    return {c: sum(found[c]) / len(found[c]) if c in found else None for c in columns}


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbouring ranks."""
    n = present_counts(df, [column])[column]
    spots = [share * (n - 1) for share in shares]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    values = dict(zip(ranks, order_statistics(df, {column: ranks})[column]))
    return [
        values[math.floor(s)] + (values[math.ceil(s)] - values[math.floor(s)]) * (s - math.floor(s))
        for s in spots
    ]


def _clean(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.when(~F.isnan(c), c)
    return c


def _narrow(df: DataFrame, targets: list[_Target], wanted: dict[int, int]) -> None:
    """One pass: each target's interval becomes the part that holds its rank."""
    # Targets of one interval share their counts.
    spans: dict[tuple, int] = {}
    for t in targets:
        spans.setdefault((t.column, t.low, t.high), len(spans))
    first = {spans[t.column, t.low, t.high]: t for t in targets}
    cells = [
        F.struct(F.lit(i).alias("i"), t.bucket().alias("b"), (F.lit(None) if t.integral else F.col(t.column)).cast("double").alias("x"),
                 (F.col(t.column) if t.integral else F.lit(None)).cast("bigint").alias("k"))
        for i, t in first.items()]
    counted = df.select(F.inline(F.array(*cells))).where("b IS NOT NULL").groupBy("i", "b").agg(
        F.count("*").alias("n"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("k").alias("lo_k"), F.max("k").alias("hi_k"))
    parts: dict[int, list] = {i: [] for i in first}
    # At most BUCKETS rows per interval.
    for r in counted.collect():
        parts[r["i"]].append((r["b"], r["n"], r["lo_k"] if r["lo_x"] is None else r["lo_x"], r["hi_k"] if r["hi_x"] is None else r["hi_x"]))
    for rows in parts.values():
        rows.sort()
    for t in targets:
        for _, n, low, high in parts[spans[t.column, t.low, t.high]]:
            if wanted[id(t)] < n:
                t.low, t.high, t.inside = low, high, n
                break
            wanted[id(t)] -= n


def grouped_order_statistics(
    df: DataFrame, group: str, value: str, ranks: Mapping[int, Sequence[float]], weight: str | None = None
) -> dict[int, list[float]]:
    """Values at zero-based ranks within each group of a long table; NULL and NaN are not counted, infinities refused.

    With ``weight`` a rank is a position in the sum of weights in order of the values: the least value up to which
    the weights exceed it. Rows without a positive weight are not counted.

    For many groups, numbered by a small column. A pass is a grouped count by interval and part; the part that
    holds a rank is found from running sums, so two rows at most per wanted rank reach the driver. The intervals,
    as many as ranks at most, are sent to the tasks.
    """
    spark = df.sparkSession
    size = F.lit(1) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("x"), size.alias("w")).where("x IS NOT NULL AND NOT isnan(x) AND w > 0")
    ends = {r["g"]: r for r in rows.groupBy("g").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    targets, wanted = [], {}
    for g, of in ranks.items():
        for rank in of:
            if g not in ends or not 0 <= rank < ends[g]["n"]:
                raise ValueError(f"rank {rank} outside the {ends[g]['n'] if g in ends else 0} values of group {g}")
            if math.isinf(ends[g]["lo"]) or math.isinf(ends[g]["hi"]):
                raise ValueError(f"group {g} holds infinities")
            targets.append(_Target(str(g), rank, False, ends[g]["lo"], ends[g]["hi"], ends[g]["n"] if weight is None else math.inf))
            wanted[id(targets[-1])] = int(rank) if weight is None else float(rank)
    while open_ := [t for t in targets if not _settled(t, wanted)]:
        spans = {k: i for i, k in enumerate(dict.fromkeys((int(t.column), t.low, t.high) for t in open_))}
        parts = max(64, min(BUCKETS, (1 << 18) // len(spans)))
        sent = spark.createDataFrame([(i, *k) for k, i in spans.items()], "span int, g int, low double, high double")
        asked = spark.createDataFrame(
            [(spans[int(t.column), t.low, t.high], i, wanted[id(t)]) for i, t in enumerate(open_)],
            f"span int, t int, rank {'long' if weight is None else 'double'}")
        # halves, so that the width of an interval stays finite
        part = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * parts).cast("int")
        counted = rows.join(F.broadcast(sent), "g").where("x >= low AND x <= high").groupBy(
            "span", F.least(F.lit(parts - 1), part).alias("b")).agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        turn = Window.partitionBy("span").orderBy("b")
        upto = counted.withColumn("upto", F.sum("n").over(turn)).withColumns({
            "before": F.coalesce(F.lag("upto").over(turn), F.lit(0)), "last": F.lead("b").over(turn).isNull()})
        # Sums of weights are rounded: what lies beyond the last of them belongs to the last part.
        found = upto.join(F.broadcast(asked), "span").where("rank >= before AND (rank < upto OR last)").select(
            "t", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi")
        for r in found.collect():
            t = open_[r["t"]]
            t.low, t.high, t.inside = r["lo"], r["hi"], r["n"] if weight is None else math.inf
            wanted[id(t)] = r["rank"]
    result: dict[int, list[float]] = {g: [] for g in ranks}
    for t in targets:
        result[int(t.column)].append(t.value)
    return result


#: What a batch of rows holds: blocks of groups' numbers and a matrix with a column of values for each, NaN for none.
Blocks = Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]]


def block_sums(df: DataFrame, blocks: Blocks, groups: int, outside: float = math.inf) -> dict[int, dict]:
    """Number, sum, least, greatest value of each group below ``groups`` that has values, and how many lie farther from nought than ``outside``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros(groups)
        low, high = np.full(groups, np.inf), np.full(groups, -np.inf)
        for batch in batches:
            for g, x in _below(blocks(batch), groups):
                some = ~np.isnan(x)
                n[g] += some.sum(axis=0)
                far[g] += (np.abs(x) > outside).sum(axis=0)
                total[g] += np.where(some, x, 0.0).sum(axis=0)
                low[g] = np.minimum(low[g], np.where(some, x, np.inf).min(axis=0, initial=np.inf))
                high[g] = np.maximum(high[g], np.where(some, x, -np.inf).max(axis=0, initial=-np.inf))
        g = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), *(pa.array(v[g]) for v in (n, far, total, low, high))], ["g", "n", "far", "total", "lo", "hi"])

    found = df.mapInArrow(partial, "g int, n long, far long, total double, lo double, hi double").groupBy("g").agg(
        F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {r["g"]: r.asDict() for r in found.collect()}


def block_order_statistics(df: DataFrame, blocks: Blocks, ranks: Mapping[int, Sequence[int]], ends: Mapping[int, Mapping] | None = None) -> dict[int, list[float]]:
    """As :func:`grouped_order_statistics`, for groups that stand side by side in the rows: no row for each value.

    Tasks count their own values by interval and part and send the parts that have some; ``ends`` are those of
    :func:`block_sums`, if they are known already.
    """
    spark, groups = df.sparkSession, max(ranks, default=-1) + 1
    ends = block_sums(df, blocks, groups) if ends is None else ends
    targets, wanted = [], {}
    for g, of in ranks.items():
        for rank in of:
            if g not in ends or not 0 <= rank < ends[g]["n"]:
                raise ValueError(f"rank {rank} outside the {ends[g]['n'] if g in ends else 0} values of group {g}")
            if math.isinf(ends[g]["lo"]) or math.isinf(ends[g]["hi"]):
                raise ValueError(f"group {g} holds infinities")
            targets.append(_Target(str(g), rank, False, ends[g]["lo"], ends[g]["hi"], ends[g]["n"]))
            wanted[id(targets[-1])] = int(rank)
    while open_ := [t for t in targets if not _settled(t, wanted)]:
        spans = {k: i for i, k in enumerate(dict.fromkeys((int(t.column), t.low, t.high) for t in open_))}
        parts = max(64, min(BUCKETS, (1 << 17) // len(spans)))
        layers = _layers(spans, groups)

        def partial(batches: Iterator[pa.RecordBatch], parts=parts, layers=layers, cells=len(spans) * parts) -> Iterator[pa.RecordBatch]:
            n, least, most = np.zeros(cells, np.int64), np.full(cells, np.inf), np.full(cells, -np.inf)
            for batch in batches:
                for g, x in _below(blocks(batch), groups):
                    for number, low, high in layers:
                        here = np.flatnonzero(number[g] >= 0)
                        if not len(here):
                            continue
                        of = g[here]
                        row, col = np.nonzero((x[:, here] >= low[of]) & (x[:, here] <= high[of]))
                        v, k = x[row, here[col]], of[col]
                        # halves, so that the width of an interval stays finite
                        part = np.floor((v / 2 - low[k] / 2) / (high[k] / 2 - low[k] / 2) * parts).astype(np.int64)
                        place = number[k] * parts + np.minimum(parts - 1, part)
                        n += np.bincount(place, minlength=cells)
                        np.minimum.at(least, place, v)
                        np.maximum.at(most, place, v)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(some // parts, pa.int32()), pa.array(some % parts, pa.int32()), *(pa.array(c[some]) for c in (n, least, most))],
                ["span", "b", "n", "lo", "hi"])

        counted = df.mapInArrow(partial, "span int, b int, n long, lo double, hi double").groupBy("span", "b").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        asked = spark.createDataFrame(
            [(spans[int(t.column), t.low, t.high], i, wanted[id(t)]) for i, t in enumerate(open_)], "span int, t int, rank long")
        turn = Window.partitionBy("span").orderBy("b")
        upto = counted.withColumn("upto", F.sum("n").over(turn))
        found = upto.join(F.broadcast(asked), "span").where("rank >= upto - n AND rank < upto").select(
            "t", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n", "lo", "hi")
        for r in found.collect():
            t = open_[r["t"]]
            t.low, t.high, t.inside = r["lo"], r["hi"], r["n"]
            wanted[id(t)] = r["rank"]
    result: dict[int, list[float]] = {g: [] for g in ranks}
    for t in targets:
        result[int(t.column)].append(t.value)
    return result


def _below(blocks: Iterable[tuple[np.ndarray, np.ndarray]], groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Without the groups that nothing is asked of."""
    for g, x in blocks:
        asked = g < groups
        yield (g, x) if asked.all() else (g[asked], x[:, asked])


def _layers(spans: Mapping[tuple, int], groups: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number (-1: none), low and high end by group of the first interval of each group, of the second, and so on."""
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    met: dict[int, int] = {}
    for (g, low, high), i in spans.items():
        at = met.get(g, 0)
        met[g] = at + 1
        if at == len(layers):
            layers.append((np.full(groups, -1), np.zeros(groups), np.zeros(groups)))
        layers[at][0][g], layers[at][1][g], layers[at][2][g] = i, low, high
    return layers


def block_medians(df: DataFrame, blocks: Blocks, counts: Mapping[int, int], ends: Mapping[int, Mapping] | None = None) -> dict[int, float]:
    """Exact medians of each group that has values, the mean of the two middle ones for an even count."""
    ranks = {g: sorted({(n - 1) // 2, n // 2}) for g, n in counts.items() if n}
    return {g: sum(v) / len(v) for g, v in block_order_statistics(df, blocks, ranks, ends).items()}


def block_quantiles(df: DataFrame, blocks: Blocks, shares: Sequence[float], counts: Mapping[int, int]) -> dict[int, list[float]]:
    """Exact quantiles of each group, linear between neighbouring ranks; ``counts`` are the present values by group."""
    return _between(shares, counts, lambda ranks: block_order_statistics(df, blocks, ranks))


def grouped_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float], counts: Mapping[int, int]) -> dict[int, list[float]]:
    """Exact quantiles of each group, linear between neighbouring ranks; ``counts`` are the present values by group."""
    return _between(shares, counts, lambda ranks: grouped_order_statistics(df, group, value, ranks))


def _between(shares: Sequence[float], counts: Mapping[int, int], at_ranks: Callable[[dict], dict]) -> dict[int, list[float]]:
    spots = {g: [share * (n - 1) for share in shares] for g, n in counts.items() if n}
    ranks = {g: sorted({r for s in at for r in (math.floor(s), math.ceil(s))}) for g, at in spots.items()}
    found = at_ranks(ranks)
    result = {}
    for g, at in spots.items():
        v = dict(zip(ranks[g], found[g]))
        result[g] = [v[math.floor(s)] + (v[math.ceil(s)] - v[math.floor(s)]) * (s - math.floor(s)) for s in at]
    return result


def grouped_medians(df: DataFrame, group: str, value: str, counts: Mapping[int, int]) -> dict[int, float]:
    """Exact medians of each group that has values, the mean of the two middle ones for an even count."""
    ranks = {g: sorted({(n - 1) // 2, n // 2}) for g, n in counts.items() if n}
    return {g: sum(v) / len(v) for g, v in grouped_order_statistics(df, group, value, ranks).items()}
