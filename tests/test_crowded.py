"""Crowded cells: how many rows the search exchanges, besides what it finds."""

from __future__ import annotations

import numpy as np

from skylattice.operators import crossmatch
from tests.test_sky import brute_nearest, frame


def exchanged(plan) -> int:
    """Rows that all exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten")
    children = plan.children()
    below = sum(exchanged(children.apply(i)) for i in range(children.size()))
    return below + (own.get().value() if own.isDefined() and kind == "ShuffleExchangeExec" else 0)


def patch(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, 50 + x, 20 + y) for i, (x, y) in enumerate(rng.uniform(0, 1e-3, (n, 2)).tolist())]


def test_left_objects_stay_few_rows(spark):
    left, right = patch(1, 1500), patch(2, 3000)
    found = crossmatch.nearest(frame(spark, left), frame(spark, right, "rid bigint, RA double, DEC double"), 0.3, ["id"], "rid", crowd=8)
    rows = {r["id"]: r["rid"] for r in found.collect()}
    assert rows == {k: v[1] for k, v in brute_nearest(left, right, 0.3).items()}
    # boxes are broadcast here; what is exchanged are the left objects, once
    assert exchanged(found._jdf.queryExecution().executedPlan()) < 2 * len(left)


def test_hole_beside_a_dense_spot(spark):
    """Left objects whose own boxes are empty at every level; the spot is wider than a box and crosses cells."""
    rng = np.random.default_rng(7)
    spot = [(i, 50 + x, 20 + y) for i, (x, y) in enumerate(rng.normal(0, 4e-6, (600, 2)).tolist())]
    left = [(i, 50 + x, 20 + y) for i, (x, y) in enumerate(rng.uniform(-6e-5, 6e-5, (120, 2)).tolist())] + [(900, 50.0, 20.0)]
    found = crossmatch.nearest(frame(spark, left), frame(spark, spot, "rid bigint, RA double, DEC double"), 0.2, ["id"], "rid", crowd=6)
    assert {r["id"]: r["rid"] for r in found.collect()} == {k: v[1] for k, v in brute_nearest(left, spot, 0.2).items()}
