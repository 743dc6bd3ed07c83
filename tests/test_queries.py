"""Every registered query against its SQL, at the smallest scale."""

import pytest
from check import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# The optional corpus queries have their own tests.
OPTIONAL = {*entry._CORPUS_QUERIES, "pipeline"}
KEYS = [key for key in entry.queries() if key not in OPTIONAL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(KEYS) == set(entry.oracle_sql()) - OPTIONAL


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    assert difference(spark, con, SF, key) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["id", "name"] and df.count() > 0
