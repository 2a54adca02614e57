"""Every registered query on the smallest tables; those with SQL against it."""

import pytest
from oracle import differences

from tallyloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert differences(df, folder, SQL[name]) == ""
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["group_id", "category", "value", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
