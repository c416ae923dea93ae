"""Every registered query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from checks import registry
from checks.fixtures import TABLES, VIEWS, ctes, view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (list, np.ndarray)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value) if isinstance(value, float) else str(value)


def content(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert content(df.columns, df.collect()) == content(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_agree(spark, duck, name):
    df = view(spark, SF, name)
    expected = duck.sql(f"WITH {ctes(name)} SELECT * FROM {name}")
    assert content(df.columns, df.collect()) == content(expected.columns, expected.fetchall())


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80


def test_boosting_runs_all_rounds_of_its_preset():
    from checks import learning

    assert [learning.small(n).params["maxIter"] for n in ("GBR", "LGB")] == [3000, 720]


def test_the_compared_regressors_keep_their_presets():
    from checks import learning
    from skylattice.plans.training import COMPARED

    assert all(learning.SMALL[n] == {} for n in COMPARED)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["obj_id", "spec_id", "d2d_arcsec", "z_spec", "mag_r"] and df.count() > 0
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()
