"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from lodeline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def _rows(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.sql(catalogue.ORACLES[name])
    assert sorted(q.columns) == cols
    assert _rows(tuple(r) for r in df.select(*cols).collect()) == _rows(q.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
