"""Hyperparameter search: grid, random draws from the grid, random draws from ranges; whole or as a race over folds."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame

from skylattice.learn.evaluate import Prediction, Setting, fit_predict, fold_parts, holdout_parts, score_candidates, with_folds
from skylattice.learn.regressors import Regressor, regressor
from skylattice.learn.trees import NO_LIMIT
from skylattice.session import staging

GRID, RANDOM, GUIDED = "GridSearch", "RandomSearch", "HyperOpt"
#: Degrees of the polynomial kernel that the guided search draws from.
DEGREES = (1, 3, 5, 7, 9)


def _steps(low: int, high: int, count: int) -> list[int]:
    return [int(low + (high - low) * i / (count - 1)) for i in range(count)]


def forest_grid(tree_counts: int = 4, depths: int = 4) -> dict[str, list]:
    """Forest grid; the last depth is no limit."""
    return {
        "numTrees": _steps(10, 500, tree_counts),
        "featureSubsetStrategy": ["all", "sqrt"],
        "maxDepth": _steps(5, 20, depths) + [NO_LIMIT],
        "minRowsToSplit": [2, 5, 10],
        "minInstancesPerNode": [1, 2, 4],
        "bootstrap": [True, False],
    }


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def forest_params(point: dict) -> dict:
    """Parameters of a grid point."""
    params = dict(point)
    if params.get("bootstrap") is False and params.get("featureSubsetStrategy") == "all":
        # such trees are all alike: one tree is the whole forest
        params["numTrees"] = 1
    return params


def random_points(grid: dict[str, list], count: int, seed: int = 0) -> list[dict]:
    """Distinct grid points; all of them when the grid is smaller than ``count``."""
    points = grid_points(grid)
    return points if count >= len(points) else random.Random(seed).sample(points, count)


def _forest_draw(rng: random.Random) -> dict:
    return {
        "numTrees": int(rng.uniform(10, 500)), "maxDepth": int(rng.uniform(5, 20)),
        "minInstancesPerNode": int(rng.uniform(1, 5)), "minRowsToSplit": int(rng.uniform(2, 6)),
        "criterion": rng.choice(("squared", "absolute")),
    }


def _boosting_draw(rng: random.Random) -> dict:
    return {"maxIter": int(rng.uniform(100, 500)), "maxDepth": int(rng.uniform(5, 20)), "stepSize": rng.uniform(0.01, 0.1)}


def _fourier_draw(rng: random.Random) -> dict:
    return {"C": math.exp(rng.gauss(0, 1)), "gamma": rng.uniform(0.001, 10000)}


def _kernel_draw(rng: random.Random) -> dict:
    return {"alpha": math.exp(rng.gauss(0, 1)), "gamma": rng.uniform(0.001, 10000), "degree": rng.choice(DEGREES), "coef0": 1.0}


# Ranges of the guided search.
DRAWS: dict[str, Callable[[random.Random], dict]] = {
    "RF": _forest_draw, "XGB": _boosting_draw, "SVR": _fourier_draw, "KRR": _kernel_draw,
}


@dataclass(frozen=True)
class Trial:
    params: dict
    #: Mean over the folds that the candidate ran.
    score: float
    folds: int


@dataclass(frozen=True)
class Search:
    best: Regressor
    trials: list[Trial]
    prediction: Prediction


def candidates(name: str, method: str, max_evals: int, seed: int = 2) -> list[dict]:
    """Distinct parameter sets to try. Only the forest has a grid; the others are searched by guided draws."""
    if name not in DRAWS:
        raise ValueError(f"{name!r} has no search, choose one of {sorted(DRAWS)}")
    if method not in (GRID, RANDOM, GUIDED):
        raise ValueError(f"method must be {GRID}, {RANDOM} or {GUIDED}, got {method!r}")
    if method == GUIDED:
        rng = random.Random(seed)
        found = [DRAWS[name](rng) for _ in range(max_evals)]
    elif name != "RF":
        raise ValueError(f"{name} has no grid, search it by {GUIDED}")
    elif method == GRID:
        found = [forest_params(p) for p in grid_points(forest_grid())]
    else:
        found = [forest_params(p) for p in random_points(forest_grid(10, 10), max_evals, seed=0)]
    return distinct(found)


def distinct(points: Iterable[dict]) -> list[dict]:
    """Each parameter set once, in order: equal fits are not repeated."""
    return list({tuple(sorted(p.items())): p for p in points}.values())


def race(tried: list[dict], name: str, df: DataFrame, setting: Setting, racing: int | None = None) -> list[Trial]:
    """Trials of all candidates over the folds of ``df``.

    With ``racing`` all run on the first fold, and after each fold only the best ``1 / racing`` of those that ran, by mean
    score so far, go on to the next. Without it all run on every fold. The folds are preprocessed and written once.
    """
    base, alive = regressor(name), list(range(len(tried)))
    scores: dict[int, list[float]] = {k: [] for k in alive}
    with staging(df.sparkSession) as stage:
        parts = fold_parts(stage(with_folds(df, setting)), setting, stage)
        for fold in range(setting.cv):
            ways = [score_candidates([base.with_params(**tried[k]) for k in alive], p, setting) for p in parts if p.fold == fold]
            for at, k in enumerate(alive):
                scores[k].append(min(way[at][1] for way in ways))
            if racing and fold + 1 < setting.cv:
                alive = sorted(sorted(alive, key=lambda k: (sum(scores[k]) / len(scores[k]), k))[:math.ceil(len(alive) / racing)])
    return [Trial(p, sum(scores[k]) / len(scores[k]), len(scores[k])) for k, p in enumerate(tried)]


def optimise(
    name: str, df: DataFrame, setting: Setting, method: str = GUIDED, max_evals: int = 200,
    points: Iterable[dict] | None = None, racing: int | None = None,
) -> Search:
    """Search on the train part, refit the best on it, predict the test part.

    Each candidate is scored by the mean over folds of the train part, scattered by the key; see :func:`race`. The best
    is the one of lowest mean among those that ran every fold. ``points`` replaces the candidates of ``method``.
    """
    tried = distinct(points) if points is not None else candidates(name, method, max_evals)
    train, test = holdout_parts(df, setting)
    trials = race(tried, name, train, setting, racing)
    best = regressor(name).with_params(**min((t for t in trials if t.folds == setting.cv), key=lambda t: t.score).params)
    return Search(best, trials, fit_predict(best, train, test, setting))
