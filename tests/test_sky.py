"""Duplicates and cross-matches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import crossmatch, dedup


def separation(ra1, dec1, ra2, dec2):
    a, b = np.radians(dec1), np.radians(dec2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(ra2 - ra1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(h)))) * 3600


def sky_points(seed, n):
    """Points crowded at the 0/360 seam, both poles and a plain spot, within a few arcsec."""
    rng = np.random.default_rng(seed)
    spots = [(0.0, 10.0), (0.0, 90.0), (180.0, -90.0), (123.4, 70.0), (359.9999, -45.0)]
    rows = []
    for i in range(n):
        ra, dec = spots[i % len(spots)]
        away, angle = rng.uniform(0, 1.5) / 3600, rng.uniform(0, 2 * math.pi)
        if abs(dec) == 90:
            rows.append((i, math.degrees(angle), math.copysign(90 - away, dec)))
        else:
            rows.append((i, (ra + away * math.cos(angle) / math.cos(math.radians(dec))) % 360, dec + away * math.sin(angle)))
    return rows


def frame(spark, rows, names="id bigint, RA double, DEC double"):
    return spark.createDataFrame(rows, names)


def brute_nearest(left, right, radius):
    out = {}
    for i, ra, dec in left:
        best = min(((float(separation(ra, dec, r, d)), j) for j, r, d in right), default=None)
        if best and best[0] < radius:
            out[i] = best
    return out


def brute_duplicates(rows, radius, first=False):
    return {
        i for i, ra, dec in rows
        if any((j < i if first else j != i) and separation(ra, dec, r, d) < radius for j, r, d in rows)
    }


def nearest(spark, left, right, radius, **options):
    found = crossmatch.nearest(
        frame(spark, left), frame(spark, right).withColumnRenamed("id", "rid"), radius, ["id"], "rid", **options
    ).collect()
    assert len({r["id"] for r in found}) == len(found)
    return {r["id"]: (r["d2d"] * 3600, r["rid"]) for r in found}


@pytest.mark.parametrize("radius", [0.05, 0.3, 2.0])
@pytest.mark.parametrize("crowd", [None, 4])
def test_nearest_equals_brute_force(spark, radius, crowd):
    left, right = sky_points(1, 300), sky_points(2, 300)
    found, expected = nearest(spark, left, right, radius, crowd=crowd), brute_nearest(left, right, radius)
    assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in expected.items()}
    assert all(abs(found[k][0] - expected[k][0]) < 1e-6 for k in found)


def test_nearest_in_a_crowd_far_from_the_left_objects(spark):
    rng = np.random.default_rng(5)
    right = [(i, 50 + rng.normal(0, 1e-8), 20 + rng.normal(0, 1e-8)) for i in range(400)]
    left = [(i, 50 + 5e-5 * math.cos(i) / math.cos(math.radians(20)), 20 + 5e-5 * math.sin(i)) for i in range(60)]
    found, expected = nearest(spark, left, right, 0.3, crowd=10), brute_nearest(left, right, 0.3)
    assert len(found) == 60
    assert all(abs(found[k][0] - expected[k][0]) < 1e-7 for k in found)


def test_copies_and_ties_go_to_the_smaller_key(spark):
    right = [(9, 10.0, 0.0), (3, 10.0, 0.0), (7, 20.0, 1e-5), (5, 20.0, -1e-5)]
    assert {k: v[1] for k, v in nearest(spark, [(1, 10.0, 0.0), (2, 20.0, 0.0)], right, 0.3).items()} == {1: 3, 2: 5}


def test_no_match_on_empty_and_missing(spark):
    nan = float("nan")
    assert nearest(spark, [], [(1, 1.0, 1.0)], 0.3) == {}
    assert nearest(spark, [(1, 1.0, 1.0)], [], 0.3) == {}
    assert nearest(spark, [(1, None, 1.0), (2, nan, 1.0)], [(1, 1.0, 1.0), (2, nan, 1.0)], 0.3) == {}


def test_match_distances_keep_every_left_row(spark):
    left = frame(spark, [(1, 10.0, 0.0), (2, 11.0, 0.0), (3, 12.0, 0.0)])
    right = frame(spark, [(5, 10.0, 5e-5), (6, 11.0, 3e-4)]).withColumnRenamed("id", "rid")
    rows = {r["id"]: r for r in crossmatch.match_distances(left, right, ["id"], "rid").collect()}
    assert (rows[1]["ismatched"], rows[2]["ismatched"], rows[3]["ismatched"]) == (True, False, False)
    assert rows[2]["rid"] == 6 and rows[3]["d2d"] is None


@pytest.mark.parametrize("policy", dedup.POLICIES)
@pytest.mark.parametrize("radius", [0.05, 0.3])
def test_duplicates_equal_brute_force(spark, policy, radius):
    rows = sky_points(3, 400)
    kept = dedup.separated(frame(spark, rows), ["id"], radius, policy=policy).collect()
    gone = brute_duplicates(rows, radius, policy == "keep_first")
    assert {r["id"] for r in kept} == {i for i, _, _ in rows} - gone
    assert len(kept) == len(rows) - len(gone)


def test_crowd_of_copies(spark):
    rows = [(i, 77.0, 33.0) for i in range(5000)] + [(9000, 77.0, 33.00005), (9001, 78.0, 33.0)]
    df = frame(spark, rows)
    assert [r["id"] for r in dedup.separated(df, ["id"]).collect()] == [9001]
    assert sorted(r["id"] for r in dedup.separated(df, ["id"], policy="keep_first").collect()) == [0, 9001]


def test_flags_keep_rows_without_position(spark):
    df = frame(spark, [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0), (4, None, 1.0), (5, float("nan"), 0.0)])
    flags = {r["id"]: r["isdup"] for r in dedup.flag_duplicates(df, ["id"]).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_composite_key_and_groups(spark):
    df = spark.createDataFrame(
        [("a", 1, 5.0, 5.0), ("b", 1, 5.0, 5.0), ("a", 2, 6.0, 5.0)], "tile string, ide bigint, RA double, DEC double"
    )
    assert dedup.separated(df, ["ide"], by=["tile"]).count() == 3
    left = dedup.separated(df, ["tile", "ide"]).collect()
    assert [(r["tile"], r["ide"]) for r in left] == [("a", 2)]
    first = dedup.separated(df, ["tile", "ide"], policy="keep_first").collect()
    assert sorted((r["tile"], r["ide"]) for r in first) == [("a", 1), ("a", 2)]


def test_threshold_is_strict(spark):
    df = frame(spark, [(1, 0.0, 0.0), (2, 0.0, 0.5)])
    exact = float(separation(0.0, 0.0, 0.0, 0.5))
    assert dedup.separated(df, ["id"], exact - 1e-6).count() == 2
    assert dedup.separated(df, ["id"], exact + 1e-6).count() == 0


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        dedup.separated(frame(spark, []), ["id"], policy="other")


def test_search_joins_on_cells_only(spark):
    df = frame(spark, sky_points(4, 50))
    plan = crossmatch.nearest(
        df, df.withColumnRenamed("id", "rid"), 0.3, ["id"], "rid", right_separated=True
    )._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
