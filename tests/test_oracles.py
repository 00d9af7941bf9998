"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def own(name):
    """Queries of the library itself; those that go with its subpackages are tested with them."""
    return re.match(r"op\d", name) is None and name != "pipeline"


@pytest.mark.parametrize("name", sorted(filter(own, entry.queries())))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.count()
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
