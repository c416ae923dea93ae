"""Choosing regressors, feature sets and features by cross-validated score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from skylattice.functions.names import band_subsets
from skylattice.learn.evaluate import SetValidator, Setting, Validation, cross_validate, validate_folds, with_folds
from skylattice.learn.features import feature_columns
from skylattice.learn.regressors import Regressor
from skylattice.operators import folds
from skylattice.session import staging

# What the morphology study adds and removes.
MORPHOLOGY_FEATURES = ("Elongation", "Rho4", "Galaxy size", "Gini index")
MORPHOLOGY_EXCLUDED = "Surf. bright."
MORPHOLOGY_BANDS = ("r", "i", "g", "u", "z")


def report(value: float, error: float) -> str:
    return f"{value:.3f}+-{abs(error):.3f}"


def _with_shuffled(df: DataFrame, setting: Setting) -> tuple[DataFrame, list[str]]:
    """Folded table with a permuted copy ``_moved<i>`` of each feature, in one pass."""
    folded = with_folds(df, setting)
    names = feature_columns(folded, setting.target, setting.bookkeeping)
    return folds.shuffle_columns(
        folded, setting.key, names, [f"_moved{i}" for i in range(len(names))], seed=setting.seed + 1), names


def _ranked(validator: SetValidator, names: Sequence[str], left: Sequence[str]) -> tuple[Validation, list[dict]]:
    """Validation on the features ``left``, and what each of them gives."""
    plain = {c: c for c in left}
    whole, *moved = validator.validate([plain] + [plain | {c: f"_moved{names.index(c)}"} for c in left])
    base, found = whole.chosen, []
    for name, v in zip(left, moved):
        score = v.chosen
        found.append({
            "Feature": name, "score": base.mean - score.mean,
            "Weight": f"{score.mean - base.mean:.3f}+-{abs(base.error + score.error):.3f}",
        })
    return whole, sorted(found, key=lambda f: f["score"])


def _all_features(wide: DataFrame, names: Sequence[str]) -> list[str]:
    return [*names, *[c for c in wide.columns if c.startswith("_moved")]]


def permutation_importance(regressor: Regressor, df: DataFrame, setting: Setting) -> list[dict]:
    """Score with one feature shuffled minus the score as it is, per feature.

    Ascending by how much the feature helps: ``score`` is base minus shuffled score, so the first
    feature is the most useful one. One table is written, with every feature and its permuted copy.
    """
    with staging(df.sparkSession) as stage:
        wide, names = _with_shuffled(df, setting)
        wide = stage(wide)
        return _ranked(SetValidator(regressor, wide, _all_features(wide, names), setting, stage), names, names)[1]


def eliminate_features(regressor: Regressor, df: DataFrame, setting: Setting) -> tuple[DataFrame, list[str]]:
    """Drop the least useful feature as long as the score improves; the table and what went.

    Folds and permuted copies are written once; each round reads its own columns.
    """
    dropped: list[str] = []
    with staging(df.sparkSession) as stage:
        wide, names = _with_shuffled(df, setting)
        wide, left, best = stage(wide), list(names), None
        validator = SetValidator(regressor, wide, _all_features(wide, names), setting, stage)
        while left:
            whole, ranked = _ranked(validator, names, left)
            if best is not None and whole.chosen.mean >= best:
                left.append(dropped.pop())
                break
            best = whole.chosen.mean
            if len(left) == 1:
                break
            dropped.append(ranked[-1]["Feature"])
            left.remove(dropped[-1])
    return df.drop(*dropped), dropped


def morphology_gain(
    regressor: Regressor, df: DataFrame, setting: Setting,
    bands: Sequence[str] = MORPHOLOGY_BANDS, features: Sequence[str] = MORPHOLOGY_FEATURES,
) -> list[dict]:
    """For every proper subset of bands left out: score with and without morphology.

    One folded table serves all runs; each reads its own columns.
    """
    found = []
    with staging(df.sparkSession) as stage:
        folded = stage(with_folds(df.drop(MORPHOLOGY_EXCLUDED), setting))
        names = feature_columns(folded, setting.target, setting.bookkeeping)
        subsets = band_subsets(bands)
        sets = []
        for left_out in subsets:
            with_shapes = {c: c for c in names if c not in left_out}
            sets += [with_shapes, {c: c for c in with_shapes if c not in features}]
        scores = [v.chosen for v in SetValidator(regressor, folded, names, setting, stage).validate(sets)]
        for left_out, a, b in zip(subsets, scores[::2], scores[1::2]):
            found.append({
                "bands": "".join(sorted(set(bands) - set(left_out))),
                "score diff.": report(a.mean - b.mean, a.error + b.error),
                "score w. morph": report(a.mean, a.error),
                "score w.o. morph": report(b.mean, b.error),
                "score": a.mean - b.mean,
            })
    return sorted(found, key=lambda f: f["score"])


@dataclass(frozen=True)
class FeatureSets(Sequence):
    """Feature sets over one table with folds; as a sequence, one projection of the table each.

    ``sets`` map feature names to columns of the table, ``keep`` are the columns of every projection.
    """

    table: DataFrame
    sets: tuple[dict[str, str], ...]
    keep: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.sets for c in s.values()))

    def __len__(self) -> int:
        return len(self.sets)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return FeatureSets(self.table, self.sets[i], self.keep)
        return self.table.select(*[F.col(f"`{c}`") for c in self.keep], *[F.col(f"`{c}`").alias(n) for n, c in self.sets[i].items()])


def select_features(
    regressor: Regressor, variants: Sequence[DataFrame], setting: Setting, max_variants: int | None = None
) -> tuple[int, list[Validation]]:
    """Number of the variant with the lowest score, and all validations.

    :class:`FeatureSets` share the passes over their table. Variants that carry a ``fold`` column are projections
    of one folded table and are read from it as they are; others are folded one by one.
    """
    if isinstance(variants, FeatureSets):
        with staging(variants.table.sparkSession) as stage:
            results = SetValidator(regressor, variants.table, variants.columns, setting, stage).validate(variants.sets[:max_variants])
        return min(range(len(results)), key=lambda i: results[i].chosen.mean), results
    results = [
        (validate_folds if "fold" in v.columns else cross_validate)(regressor, v, setting)
        for v in variants[:max_variants]
    ]
    return min(range(len(results)), key=lambda i: results[i].chosen.mean), results


def select_regressor(
    regressors: Sequence[Regressor], variants: Sequence[DataFrame], setting: Setting, max_variants: int | None = None
) -> tuple[Regressor, int, list[dict]]:
    """Best regressor and feature set, with the best scores of each regressor, lowest first."""
    table = []
    for r in regressors:
        index, results = select_features(r, variants, setting, max_variants)
        v = results[index]
        table.append({
            "method": r.name, "variant": index, "preprocessing": str(v.preprocessing),
            "score": v.chosen.mean, "score_error": v.chosen.error, "sigma": v.sigma.mean, "sigma_error": v.sigma.error,
            "eta": v.eta.mean, "eta_error": v.eta.error,
        })
    table.sort(key=lambda t: t["score"])
    best = next(r for r in regressors if r.name == table[0]["method"])
    return best, table[0]["variant"], table


def report_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """Small result rows as a table."""
    names = [part.strip().rsplit(" ", 1)[0].strip("`") for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def with_setting(setting: Setting, **changes) -> Setting:
    return replace(setting, **changes)
