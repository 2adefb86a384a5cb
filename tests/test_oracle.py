"""Every registered query against its SQL twin on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_rows_only(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
