"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_twin_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, QUERIES[name], SQL.get(name))
    # Small tables may leave a rule without a case; differing rows are what counts.
    assert ok is not False or text == "0 rows", text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "position", "toc_level", "text", "target"] and df.count() > 0
