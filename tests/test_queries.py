"""Each query of the engine against its DuckDB SQL on the smallest tables."""

import pytest

from compare import duck, rows
from plumbline import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry_has_all():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
