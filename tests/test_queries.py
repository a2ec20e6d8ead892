"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from morae import catalog

from .conftest import DATA, rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
@pytest.mark.parametrize("name", sorted(set(SQL) & set(QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    assert sorted(d[0] for d in cursor.description) == columns
    assert rows(df, columns) == rows(cursor, columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
