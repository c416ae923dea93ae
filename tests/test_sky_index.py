"""Stored catalogues against brute force, and the plans of their searches."""

import re

import pytest

from skylattice.operators import sky_index
from skylattice.plans import surveys
from test_sky import brute_nearest, frame, sky_points


def stored(spark, folder, rows, radius=1.0, **options):
    right = frame(spark, rows).withColumnRenamed("id", "rid").selectExpr("*", "RA * 2 AS twice")
    return sky_index.write(right, str(folder), "rid", radius, ["twice"], **options)


def search(index, left, radius, **options):
    found = index.nearest(left, radius, ["id"], **options).collect()
    assert len({r["id"] for r in found}) == len(found)
    return {r["id"]: (r["d2d"] * 3600, r["rid"]) for r in found}


def agrees(found, expected):
    return found.keys() == expected.keys() and all(
        found[i][1] == expected[i][1] and found[i][0] == pytest.approx(expected[i][0], abs=1e-6) for i in found)


@pytest.mark.parametrize("crowd", [None, 4])
def test_search_equals_brute_force_at_every_radius(spark, tmp_path, crowd):
    left, right = sky_points(1, 60), sky_points(2, 80)
    index = stored(spark, tmp_path / "i", right, buckets=3, crowd=crowd)
    assert index.has_crowds == (crowd == 4)
    for radius in (1.0, 0.3):
        assert agrees(search(index, frame(spark, left), radius), brute_nearest(left, right, radius))


def test_an_index_found_again_by_its_path(spark, tmp_path):
    left, right = sky_points(3, 40), sky_points(4, 40)
    stored(spark, tmp_path / "i", right, buckets=3)
    again = sky_index.reopen(spark.newSession(), str(tmp_path / "i"))
    assert (again.key, again.payload, again.radius_arcsec) == ("rid", ("twice",), 1.0)
    here = sky_index.reopen(spark, str(tmp_path / "i"))
    assert agrees(search(here, frame(spark, left), 1.0), brute_nearest(left, right, 1.0))


def test_only_the_left_side_is_exchanged(spark, tmp_path):
    index = stored(spark, tmp_path / "i", sky_points(5, 200), buckets=4)
    plan = index.nearest(frame(spark, sky_points(6, 50)), 0.5, ["id"])._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("SortMergeJoin"):]
    side = joined[joined.index("FileScan"):]
    assert "Exchange" not in joined[joined.rindex("Exchange") + 8:joined.index("FileScan")]
    assert joined.count("Exchange") == 1 and "Bucketed: true" in side and "SelectedBucketsCount: 4 out of 4" in side
    assert "Broadcast" not in plan
    # of the payload only what is asked for is read
    bare = index.nearest(frame(spark, sky_points(6, 50)), 0.5, ["id"], payload=[])
    schema = re.search(r"ReadSchema: (.*)", bare._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "twice" not in schema


def test_odd_catalogues(spark, tmp_path):
    nan = float("nan")
    right = [(5, 10.0, 1.0), (3, 10.0, 1.0), (7, None, 1.0), (8, nan, 1.0), (9, 10.0, 1.0 + 0.2 / 3600), (10, 10.0, 1.0 - 0.2 / 3600)]
    index = stored(spark, tmp_path / "i", right)
    left = [(1, 10.0, 1.0), (1000, None, 2.0), (2, 50.0, 1.0)]
    assert {k: v[1] for k, v in search(index, frame(spark, left), 0.3).items()} == {1: 3}
    with pytest.raises(ValueError):
        index.nearest(frame(spark, left), 1.5, ["id"])
    with pytest.raises(ValueError):
        index.nearest(frame(spark, left), 0.3, ["id"], payload=["other"])
    assert search(index, frame(spark, []), 0.3) == {}
    nothing = stored(spark, tmp_path / "none", [])
    assert not nothing.has_crowds and search(nothing, frame(spark, left), 0.3) == {}


def test_the_survey_chain_on_stored_catalogues(spark, tmp_path):
    base = spark.createDataFrame([(1, 10.0, 1.0, 21.0, 20.0, 19.0, 18.0, 17.0)], "u_id bigint, RA double, DEC double,"
                                 " MAG_u double, MAG_r double, g_stk_aper double, i_stk_aper double, z_stk_aper double")
    r = spark.createDataFrame([(7, 10.0, 1.0, 20.5, 0.3)], "ide bigint, RA double, DEC double, MAG_AUTO_R double, Z_SPEC double")
    index = sky_index.write(r, str(tmp_path / "r"), "ide", 0.3, ["MAG_AUTO_R", "Z_SPEC"])
    for right in (r, index):
        table, _ = surveys.with_redshift(base, right, "ide", morphology=False)
        assert [tuple(x) for x in table.collect()] == [(1, 20.5, 21.0, 18.0, 17.0, 19.0, 0.3)]
        assert surveys.without_redshift(base, right, "ide").count() == 1
    with pytest.raises(ValueError):
        surveys.without_redshift(base, index, "other")
