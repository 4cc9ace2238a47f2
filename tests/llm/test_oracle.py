"""The queries of the training-data operators that SQL can say give the same rows as DuckDB."""

import pytest

from gridloom.llm.queries import oracle_sql, queries

SQL = oracle_sql()


def plain(row):
    return tuple(float(v) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    got, want = queries()[name](spark, small), duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(plain, got.select(*columns).collect()), key=repr)
    assert rows == sorted(map(plain, want.fetchall()), key=repr) and rows
