"""Trees against plain searches for the best split; sums over all rows against one task; what is drawn by hashing."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skylattice.learn import trees
from skylattice.learn.trees import Growth, grow_here, median, walk
from skylattice.operators import order_stats
from skylattice.session import staging


def data(n=400, seed=0, kinds=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, kinds, (n, 4))
    y = np.sin(x[:, 0]) + 0.3 * (x[:, 1] > 5) * x[:, 2] + rng.normal(size=n) * 0.1
    return x, y, rng.uniform(0.5, 2.0, n)


def frame(spark, x, y, w):
    rows = [(Vectors.dense(list(map(float, r))), float(v), float(u)) for r, v, u in zip(x, y, w)]
    return spark.createDataFrame(rows, ["features", "_label", "_weight"]).repartition(3)


def plain_tree(x, y, w, growth, depth=0, cost=None):
    """Recursive search over all splits; a leaf is its value, a node ``(feature, cut, left, right)``."""
    cost = cost or (lambda v, u: -((u * v).sum() ** 2) / (u.sum() + growth.ridge))
    answer = median(y, w) if growth.absolute else (w * y).sum() / (w.sum() + growth.ridge)
    best = None
    if depth < growth.depth and len(y) >= growth.least_split:
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if min(left.sum(), (~left).sum()) < growth.least_leaf or min(w[left].sum(), w[~left].sum()) < growth.least_hessian:
                    continue
                total = cost(y[left], w[left]) + cost(y[~left], w[~left])
                if best is None or total < best[0] - 1e-9 * abs(best[0]):
                    best = (total, f, c)
    whole = cost(y, w)
    if best is None or whole - best[0] <= max(growth.least_gain, 1e-9 * abs(whole)):
        return answer
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], plain_tree(x[left], y[left], w[left], growth, depth + 1, cost), plain_tree(x[~left], y[~left], w[~left], growth, depth + 1, cost))


def answers(tree, x):
    def one(node, r):
        while isinstance(node, tuple):
            node = node[2] if r[node[0]] <= node[1] else node[3]
        return node
    return np.array([one(tree, r) for r in x])


LIMITS = [Growth(depth=4), Growth(depth=6, least_leaf=5), Growth(depth=20, least_split=30), Growth(depth=5, ridge=3.0, least_gain=0.5), Growth(depth=5, least_hessian=20.0)]


@pytest.mark.parametrize("growth", LIMITS)
def test_tree_equals_plain_search(growth):
    x, y, w = data()
    nodes = grow_here(x, w * y, w, growth).arrays()
    assert np.allclose(nodes[4][walk(nodes, x)], answers(plain_tree(x, y, w, growth), x))


@pytest.mark.parametrize("growth", LIMITS)
def test_sums_over_all_rows_equal_one_task(spark, growth):
    """Grown by sums alone, by sums down to small nodes, and by one task a tree: the same answers."""
    x, y, w = data()
    table = frame(spark, x, y, w)
    expected = answers(plain_tree(x, y, w, growth), x)
    with staging(spark) as stage:
        for local_rows in (0, 120, 10_000):
            model = trees.forest(table, 1, growth, 64, 4, stage, local_rows)
            assert np.allclose(model.raw(trees.to_bins(x.astype(float), model.ends)), expected)


def absolute_cost(v, u):
    return (u * np.abs(v - median(v, u))).sum()


def test_absolute_criterion(spark):
    """Up to TARGET_BINS rows in a node every cost is exact."""
    x, y, _ = data(60)
    y, w = np.round(y, 2), np.ones(60)
    growth = Growth(depth=3, absolute=True)
    tree = plain_tree(x, y, w, growth, cost=absolute_cost)
    nodes = grow_here(x, w * y, w, growth).arrays()
    assert np.abs(y - nodes[4][walk(nodes, x)]).sum() == pytest.approx(np.abs(y - answers(tree, x)).sum())
    x, y, w = data(500)
    table = frame(spark, x, y, w)
    with staging(spark) as stage:
        by_task, by_sums = (trees.forest(table, 1, growth, 64, 4, stage, k) for k in (10_000, 0))
    best = (w * np.abs(y - answers(plain_tree(x, y, w, growth, cost=absolute_cost), x))).sum()
    for model in (by_task, by_sums):
        b = trees.to_bins(x.astype(float), model.ends)
        at = walk(model.nodes[0], b)
        for leaf in np.unique(at):  # the answers are exact medians
            assert model.nodes[0][4][leaf] == pytest.approx(median(y[at == leaf], w[at == leaf]))
        assert (w * np.abs(y - model.raw(b))).sum() <= 1.05 * best


def test_median_of_weights():
    assert median(np.array([3.0, 1.0, 2.0]), np.ones(3)) == 2 and median(np.array([4.0, 1.0]), np.ones(2)) == 2.5
    assert median(np.array([1.0, 2.0, 9.0]), np.array([1.0, 1.0, 5.0])) == 9


def test_prefixes_and_cut_trees(spark):
    """The first trees of a forest are the smaller forest; a limit on depth or size cuts the same tree."""
    x, y, w = data()
    table, rule = frame(spark, x, y, w), dict(bootstrap=True, node_features=0.5, seed=3)
    with staging(spark) as stage:
        big = trees.forest(table, 5, Growth(**rule), 64, 4, stage)
        b = trees.to_bins(x.astype(float), big.ends)
        small = trees.forest(table, 2, Growth(**rule), 64, 4, stage)
        # other files, other numbers of the rows: only forests of one table of bins share their draws
        assert len(small.nodes) == 2 and len(big.nodes) == 5
        rows = trees.binned(table, big.ends, stage).toPandas()
    xb = np.stack([np.frombuffer(r, np.uint16) for r in rows["x"]]).astype(np.int64)
    for limit in (dict(depth=3), dict(least_split=40), dict(depth=5, least_split=20)):
        for t in range(3):
            h = rows["w"].to_numpy() * trees.drawn(rows["id"].to_numpy(), Growth(**rule), t)
            full = grow_here(xb, h * rows["y"].to_numpy(), h, Growth(**rule), t).arrays()
            cut = grow_here(xb, h * rows["y"].to_numpy(), h, Growth(**rule, **limit), t).arrays()
            assert np.allclose(full[4][walk(full, b, limit.get("depth", trees.NO_LIMIT), limit.get("least_split", 0))], cut[4][walk(cut, b)])


def test_draws():
    ids = np.arange(200_000)
    counts = trees.drawn(ids, Growth(bootstrap=True), 4)
    assert abs(counts.mean() - 1) < 0.01 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    part = Growth(rows=0.8, redraw=5)
    assert abs(trees.drawn(ids, part, 0).mean() - 0.8) < 0.01
    assert (trees.drawn(ids, part, 1) == trees.drawn(ids, part, 4)).all() and (trees.drawn(ids, part, 4) != trees.drawn(ids, part, 5)).any()
    mask = trees._allowed(np.arange(1, 500, dtype=np.uint64), Growth(node_features=0.5), 0, 6)
    assert (mask.sum(axis=1) == 3).all() and mask.mean(axis=0) == pytest.approx([0.5] * 6, abs=0.1)
    assert len(np.unique(trees._allowed(np.arange(1, 50, dtype=np.uint64), Growth(tree_features=0.4), 0, 6), axis=0)) == 1


def boosted_by_hand(x, y, w, rounds, rate, growth, base):
    f = np.full(len(y), base)
    for _ in range(rounds):
        f = f + rate * answers(plain_tree(x, y - f, w, growth), x)
    return f


def test_boosting_equals_plain_boosting(spark, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 3)
    x, y, w = data(250)
    table = frame(spark, x, y, w)
    with staging(spark) as stage:
        for growth, base in ((Growth(depth=2), None), (Growth(depth=3, ridge=2.0, least_hessian=5.0), 0.5)):
            model = trees.boosted(table, 8, 0.3, growth, 64, 4, stage, base)
            got = model.raw(trees.to_bins(x.astype(float), model.ends))
            assert np.allclose(got, boosted_by_hand(x, y, w, 8, 0.3, growth, (w * y).sum() / w.sum() if base is None else base))


@pytest.mark.parametrize("growth,weighted", [
    (Growth(depth=4, node_features=0.5, seed=3), False), (Growth(depth=3, ridge=1.0, least_hessian=1.0), True),
    (Growth(leaves=5, least_leaf=6, tree_features=0.5, rows=0.8, redraw=5, seed=9), True)])
def test_tasks_that_keep_their_rows_boost_as_passes_do(spark, monkeypatch, growth, weighted):
    """One task, four tasks that hear each other's sums, and passes over the table: the same trees from the same rows of bins."""
    x, y, w = data(300)
    table, shares = frame(spark, x, y, w if weighted else np.ones(300)), []
    plain = trees._held_rounds
    monkeypatch.setattr(trees, "_held_rounds", lambda rows, tasks, *rest: shares.append(tasks) or plain(rows, tasks, *rest))
    with staging(spark) as stage:
        rows = stage(trees.binned(table, trees.bin_ends(table, 4, 64), stage))
        monkeypatch.setattr(trees, "binned", lambda *_: rows)
        found = []
        for held_rows, held_bytes in ((1000, 1 << 29), (75, 1 << 29), (1000, 1)):
            monkeypatch.setattr(trees, "HELD_ROWS", held_rows)
            monkeypatch.setattr(trees, "HELD_BYTES", held_bytes)
            found.append(trees.boosted(table, 12, 0.3, growth, 64, 4, stage))
    assert shares == [1, 4] and all(len(m.nodes) == 12 for m in found)
    expected = found[2].raw(x)
    assert all(np.allclose(m.raw(x), expected) for m in found) and np.abs(y - expected).mean() < 0.5 * np.abs(y - y.mean()).mean()


def test_tasks_that_see_no_common_files_say_so(tmp_path):
    alone = trees._Exchange(str(tmp_path / "a"), 0, 2)
    assert alone.heard(b"x", 0.05) is None
    single = trees._Exchange(str(tmp_path / "b"), 0, 1)
    assert [single.heard(m) for m in (b"x", b"", b"z")] == [[b"x"], [b""], [b"z"]] and len(list((tmp_path / "b").iterdir())) == 1


def test_growth_by_best_leaf(spark):
    """The leaf that gains most is split, until there are five."""
    x, y, w = data(300)
    growth = Growth(leaves=5, least_leaf=6, least_hessian=11.0)

    def best(rows):
        t = plain_tree(x[rows], y[rows], w[rows], Growth(depth=1, least_leaf=6, least_hessian=11.0))
        if not isinstance(t, tuple):
            return 0.0, None, None
        left = rows[x[rows, t[0]] <= t[1]]
        right = rows[x[rows, t[0]] > t[1]]
        score = lambda r: (w[r] * y[r]).sum() ** 2 / w[r].sum()
        return score(left) + score(right) - score(rows), left, right

    leaves = [np.arange(300)]
    while len(leaves) < 5:
        k = max(range(len(leaves)), key=lambda k: best(leaves[k])[0])
        _, a, b = best(leaves.pop(k))
        leaves += [a, b]
    expected = np.empty(300)
    for rows in leaves:
        expected[rows] = (w[rows] * y[rows]).sum() / w[rows].sum()
    with staging(spark) as stage:
        model = trees.boosted(frame(spark, x, y, w), 1, 1.0, growth, 64, 4, stage, 0.0)
    assert np.allclose(model.raw(trees.to_bins(x.astype(float), model.ends)), expected)


def test_bins(spark):
    rng = np.random.default_rng(1)
    x, w = np.stack([rng.normal(size=900), rng.integers(0, 5, 900), np.full(900, 7.0)], axis=1), rng.uniform(0, 3, 900)
    table = frame(spark, x, np.zeros(900), w)
    ends = trees.bin_ends(table, 3, 10)
    assert list(ends[1]) == [0.5, 1.5, 2.5, 3.5] and not len(ends[2])
    assert list(ends[0]) == [np.sort(x[:, 0])[int(900 * k / 10)] for k in range(1, 10)]
    by_weight = trees.bin_ends(table, 3, 10, weighted=True)[0]
    parts = np.bincount(np.searchsorted(by_weight, x[:, 0], "left"), w, 10) / w.sum()
    assert np.abs(parts - 0.1).max() < 0.01
    assert (trees.to_bins(x, ends).max(axis=0) == [9, 4, 0]).all()


def test_weighted_order_statistics(spark):
    rng = np.random.default_rng(5)
    x, w = np.round(rng.normal(size=300), 1), rng.uniform(0, 2, 300)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, w)] + [(0, 5.0, 0.0), (0, 6.0, None)], "g int, x double, w double")
    order = np.argsort(x, kind="stable")
    at = [0.0, w.sum() / 3, w.sum() / 2, w.sum() * 0.999]
    expected = [x[order][np.searchsorted(np.cumsum(w[order]), p, "right")] for p in at]
    assert order_stats.grouped_order_statistics(df, "g", "x", {0: at}, weight="w")[0] == pytest.approx(expected)


def test_table_without_rows_or_weights(spark):
    table = spark.createDataFrame([(Vectors.dense([1.0]), 2.0, 0.0)], ["features", "_label", "_weight"])
    with staging(spark) as stage:
        for t in (table, table.limit(0)):
            model = trees.forest(t, 2, Growth(), 8, 1, stage)
            assert model.raw(np.zeros((1, 1), int)) == [0.0]


def test_rows_of_a_node_travel_in_few_bytes():
    """Rows of a node that one task finishes: bins in two bytes each, everything else unrounded."""
    rng = np.random.default_rng(11)
    ids, h, y, x = rng.integers(0, 1 << 60, 7), rng.uniform(size=7), rng.uniform(size=7), rng.integers(0, 1 << 16, (7, 5))
    data = trees._pack(ids, h, y, x)
    assert len(data) == 7 * (24 + 2 * 5)
    assert all((a == b).all() for a, b in zip(trees._unpack(data, 5), (ids, h, y, x)))


def test_rows_of_bins_and_blocks(spark):
    """Bins come out of a sliced batch as they went in; blocks hold every row once, with its answer; boosting reads blocks."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 300, (50, 3)).astype(np.uint16)
    batch = trees.pa.RecordBatch.from_arrays([
        trees.pa.array(range(50)), trees.pa.array([r.tobytes() for r in x], trees.pa.binary()), trees.pa.array(rng.normal(size=50)),
        trees.pa.array(np.ones(50))], ["id", "x", "y", "w"])
    for part in (batch, batch.slice(7, 20), batch.slice(3, 0)):
        ids, bins, *_ = trees._arrays(part, 3)
        assert bins.shape == (part.num_rows, 3) and (bins == x[ids]).all()
    rows = spark.createDataFrame([(i, r.tobytes(), float(i), 2.0) for i, r in enumerate(x)], "id long, x binary, y double, w double").repartition(3)
    blocks = trees._blocked(rows, 0.25, 3)
    assert blocks.count() == 3
    parts = [p for b in blocks.toArrow().to_batches() for p in trees._parts(b, 3)]
    ids, bins, y, w, margin = (np.concatenate(c) for c in zip(*parts))
    assert sorted(ids) == list(range(50)) and (bins == x[ids]).all() and (y == ids).all() and (w == 2).all() and (margin == 0.25).all()


def test_small_trees_lead_rows_alike(monkeypatch):
    """Split by split over all rows or row by row, a tree gives the same node under every limit."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 40, (400, 3)), rng.normal(size=400)
    nodes = trees.grow_here(x, y, np.ones(400), trees.Growth(depth=5)).arrays()
    assert 8 < (nodes[0] >= 0).sum() <= trees.SMALL_TREE
    for limits in ((), (2,), (4, 30)):
        quick = trees.walk(nodes, x.astype(np.uint16), *limits)
        with monkeypatch.context() as patch:
            patch.setattr(trees, "SMALL_TREE", -1)
            assert (quick == trees.walk(nodes, x, *limits)).all()
