"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic class. The tokens of the cells are raked: each
marginal in turn is scaled to its target shares, for ``SWEEPS`` rounds. The ratio of raked to observed
tokens is a cell's relative weight; one factor turns weights into inclusion probabilities of at most one,
so that the expected number of tokens is ``share`` of all. A document is taken if a number drawn from its
id lies below its cell's probability, so the same documents are taken on every run.

A target names the classes of its margin and their shares; a value it does not name, a null among them,
falls into the class ``*``, which keeps its observed share. Classes without tokens lose their share to the
others. So the table of cells is bounded by the targets, whatever the data hold: it alone is collected, and
sent to the tasks.

Defined results: a null or empty text has no tokens; a cell without tokens has relative weight one; a null
id draws as an empty one, rows that repeat an id draw the same number; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

OTHER = "*"
SWEEPS = 60
MARGINS = ("source", "lang", "topic")

#: The white space that parts words, as a pattern of either engine.
WORD = r"[^ \x09-\x0D]+"
MARKUP = "|#$%&*<>{}="
LONGFORM_WORDS, ARTICLE_WORDS = 800, 250


@dataclass(frozen=True)
class Targets:
    """Target shares of tokens by class of each margin, and the share of all tokens to take."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 0.05 for i in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2})
    topic: dict[str, float] = field(default_factory=lambda: {"note": 0.1, "article": 0.3, "longform": 0.5, "markup": 0.1})
    share: float = 0.5


def tokens() -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def topic() -> Column:
    """Kind of text by its form: markup, else by its length."""
    marks = F.length("text") - F.length(F.translate("text", MARKUP, ""))
    return (F.when(F.coalesce(20 * marks > F.length("text"), F.lit(False)), "markup").when(F.col("n_tokens") >= LONGFORM_WORDS, "longform")
            .when(F.col("n_tokens") >= ARTICLE_WORDS, "article").otherwise("note"))


def classed(docs: DataFrame, targets: Targets) -> DataFrame:
    """``docs`` with ``n_tokens`` and the class of each margin as ``class_source, class_lang, class_topic``.

    Columns of these names that ``docs`` has already are replaced.
    """
    wide = docs.withColumn("n_tokens", tokens()).withColumn("class_topic", topic())
    for m in MARGINS:
        value = F.col("class_topic" if m == "topic" else m)
        wide = wide.withColumn(f"class_{m}", F.when(value.isin(list(getattr(targets, m))), value).otherwise(F.lit(OTHER)))
    return wide


def rake(observed: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], sweeps: int = SWEEPS) -> np.ndarray:
    """``observed`` scaled so that each margin's classes hold their shares of the total.

    A margin is the class number of each cell and the target share of each class (nan: as observed).
    """
    total, w = observed.sum(), observed.astype(float).copy()
    if not total:
        return w
    shares = []
    for number, target in margins:
        have = np.bincount(number, observed, len(target))
        named = ~np.isnan(target) & (have > 0)
        share = np.where(named, 0.0, have / total)
        left = target[named].sum()
        share[named] = target[named] * (1 - share.sum()) / left if left else 0.0
        shares.append(share)
    for _ in range(sweeps):
        for (number, _), share in zip(margins, shares):
            now = np.bincount(number, w, len(share))
            w = w * np.divide(share * total, now, out=np.zeros(len(share)), where=now > 0)[number]
    return w


def probabilities(observed: np.ndarray, raked: np.ndarray, share: float) -> np.ndarray:
    """Least of one and a common factor times weight, such that the expected tokens are ``share`` of all."""
    ratio = np.divide(raked, observed, out=np.ones(len(observed)), where=observed > 0)
    goal = min(1.0, share) * observed.sum()
    order = np.argsort(-ratio, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(observed[order])])
    rest = np.concatenate([np.cumsum((observed * ratio)[order][::-1])[::-1], [0.0]])
    for k in range(len(order) + 1):
        if k == len(order) or rest[k] <= 0:
            return np.minimum(1.0, np.where(ratio > 0, 1.0, 0.0))
        factor = (goal - full[k]) / rest[k]
        if factor * ratio[order[k]] <= 1.0:
            return np.clip(factor * ratio, 0.0, 1.0)
    return np.ones(len(order))


def draw(key: str) -> Column:
    """A number from 0 to 1 that the key alone decides."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, targets: Targets = Targets(), key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_tokens``, the classes, ``probability`` and ``taken``."""
    spark, names = docs.sparkSession, [f"class_{m}" for m in MARGINS]
    wide = classed(docs.drop("probability", "taken"), targets)
    # As many rows as there are combinations of named classes, at most.
    cells = wide.groupBy(*names).agg(F.sum("n_tokens").alias("n")).toPandas().sort_values(names)
    observed = cells["n"].to_numpy(float)
    margins = []
    for m in MARGINS:
        target = getattr(targets, m) | {OTHER: np.nan}
        order = list(target)
        margins.append((np.array([order.index(c) for c in cells[f"class_{m}"]], int), np.array([target[c] for c in order], float)))
    p = probabilities(observed, rake(observed, margins), targets.share)
    rows = [(*c, float(round(x, 9))) for c, x in zip(cells[names].itertuples(index=False, name=None), p)]
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", probability double")
    return wide.join(F.broadcast(table), names, "left").withColumn("taken", draw(key) < F.col("probability"))
