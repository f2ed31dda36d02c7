"""Every named query against its SQL twin on another engine."""

import os

import pytest
from compare import compare, duck

from leakscan.plans import all_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, REGISTRY, name, DATA) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "blocked", "pattern_name", "records", "total_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
