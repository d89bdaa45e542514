"""Every query with SQL equals DuckDB's result; the rest run and return rows."""

import pytest

from veilspark import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(same, name):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["t"] for r in rows] == list(range(1, 21))
    shares = [r["share"] for r in rows]
    assert shares == sorted(shares) and shares[-1] == 1.0
