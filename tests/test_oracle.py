"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from canopygrid.plans import catalog_plans, raster_plans, zonal_plans
from compare import connect, differences

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


# The queries of the library itself; parts of their own are tested beside them.
CORE = sorted({**catalog_plans.QUERIES, **raster_plans.QUERIES, **zonal_plans.QUERIES})


def test_every_query_has_sql():
    assert set(CORE) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) == []


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["aoi", "index_name", "month", "ecozone", "n_scenes", "p95", "p100"]
    assert df.filter("p95 IS NOT NULL").count() > 0
