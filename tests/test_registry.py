"""Every query with SQL gives the SQL's rows on the smallest driver tables."""

import duckdb
import pytest

from narrata.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return cols, sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    got, want = _rows(registry.QUERIES[name](spark, sf).toPandas()), _rows(duck.execute(registry.ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
