"""A result beside that of its SQL."""

from compare import rows


def same_as_sql(df, cur):
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
