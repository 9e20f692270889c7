"""Every catalogue query against its SQL counterpart on the smallest driver tables."""

from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(str(FOLDER))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in SQL:
        assert differences(got, duck.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_one_name():
    assert set(SQL) <= set(QUERIES)
