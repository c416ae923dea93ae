"""Scores of forests that share trees, against trees grown for each limit alone."""

import numpy as np
import pytest

from skylattice.learn import forest_search, regressors, trees


def data(n, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 4))
    return x, 0.5 + 0.1 * np.sin(x[:, 0]) + 0.02 * (x[:, 1] > 5) * x[:, 2] + rng.normal(size=n) * 0.01


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, z double")


POINTS = [
    {"numTrees": n, "maxDepth": depth, "minRowsToSplit": least, "minInstancesPerNode": leaf, "featureSubsetStrategy": "sqrt", "bootstrap": False}
    for n, depth, least, leaf in ((3, 2, 2, 1), (30, 2, 2, 1), (30, trees.NO_LIMIT, 2, 1), (7, 4, 20, 1), (28, 4, 20, 3), (28, 3, 5, 3))]


def test_tables_above_a_nodes_rows_share_trees(spark, monkeypatch):
    """More rows than one task finishes a node with: the trees are still shared, and every forest scores as if grown alone."""
    monkeypatch.setattr(trees, "LOCAL_ROWS", 50)
    (x, y), (xt, yt) = data(300), data(120, 5)
    got = forest_search.scores(POINTS, frame(spark, x, y), frame(spark, xt, yt), ["a", "b", "c", "d"], "z", None)
    assert got is not None
    for p, s in zip(POINTS, got):
        growth = regressors.forest_growth({**regressors.regressor("RF").params, **p}, 4)
        grown = [trees.grow_here(x, y, np.ones(300), growth, t).arrays() for t in range(p["numTrees"])]
        guess = sum(g[4][trees.walk(g, xt)] for g in grown) / p["numTrees"]
        assert (s.sigma, s.eta, s.bias) == pytest.approx(forest_search._scores(yt, guess)[:3])


def test_tables_too_large_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(forest_search, "SHARED_BYTES", 100 * 32 - 1)
    assert forest_search.scores(POINTS, frame(spark, *data(100)), frame(spark, *data(20)), ["a", "b", "c", "d"], "z", None) is None


def test_one_walk_gives_all_limits():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, (500, 3)), rng.normal(size=500)
    nodes = trees.grow_here(x, y, np.ones(500), trees.Growth()).arrays()
    xt = rng.integers(0, 30, (200, 3)).astype(np.uint16)
    cuts = {0: {2}, 1: {2, 40}, 4: {5, 40}, trees.NO_LIMIT: {2, 5, 40}}
    found = {(d, s): v.copy() for d, s, v in forest_search._led(nodes, xt, cuts)}
    assert set(found) == {(d, s) for d, leasts in cuts.items() for s in leasts}
    assert all((v == nodes[4][trees.walk(nodes, xt, d, s)]).all() for (d, s), v in found.items())


def test_sizes_and_ties_of_wide_levels():
    """Levels of very many nodes: rows that all differ are parted down to single rows, weighted or not."""
    rng = np.random.default_rng(7)
    x, y = rng.permutation(3000)[:, None], rng.normal(size=3000)
    for h in (np.ones(3000), rng.integers(1, 4, 3000).astype(float)):
        nodes = trees.grow_here(x, h * y, h, trees.Growth()).arrays()
        assert (nodes[0] < 0).sum() == 3000 and np.allclose(nodes[4][trees.walk(nodes, x)], y)
        assert nodes[5][0] == 3000 and nodes[5][nodes[0] < 0].max() == 1
