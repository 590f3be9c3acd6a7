"""Every query with SQL equals it; the others run. The optional subpackage has tests of its own."""

import pytest
from oracle import compare, database

from canvass.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    if name in ORACLE_SQL:
        assert compare(spark, db, QUERIES[name], ORACLE_SQL[name], sf) == ""
    else:
        assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and "cluster_id" in rows.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
