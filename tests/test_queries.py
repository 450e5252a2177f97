"""Every query with check SQL, on the smallest data set, and the driver's entry."""

import pytest

import __spark_entry__ as entry_points
from check import compare, connect
from rillwatch.plans import catalog

SF = "/root/testdata/sf0.001"
CHECKED = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_query_matches_sql(spark, con, name):
    ok, _n, _m, note = compare(QUERIES[name](spark, SF), con, CHECKED[name])
    assert ok, note


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "total_flows" in df.columns


def test_names():
    assert set(CHECKED) <= set(QUERIES)
    # these names belong to the optional text operators
    assert not [n for n in catalog.QUERIES if "pipeline" in n or n.startswith("op")]
