"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries that rightly have no rows on the smallest tables.
EMPTY_HERE: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        found = differences(df, con, SQL[name])
        assert found is None or (name in EMPTY_HERE and found.startswith("EMPTY")), found
    else:
        assert df.count() >= 0


def test_entry_is_registered():
    assert "elevated_periods_per_band" in QUERIES
    assert set(SQL) <= set(QUERIES)
