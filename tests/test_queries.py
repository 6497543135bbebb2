"""Every registered query with SQL gives the SQL's rows; the others run. The registry works without its optional part."""

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]
import oracle  # noqa: E402

from textloom import registry  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return oracle.connect()


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(spark, db, tmp_path, name):
    assert oracle.differences(spark, db, name, QUERIES[name], SQL[name], str(tmp_path / name)) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, oracle.FOLDER)
    assert rows.columns and rows.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
