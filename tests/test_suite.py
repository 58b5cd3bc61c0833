"""Every registered query of the reference's operators against DuckDB."""

import datetime as dt
import decimal

import duckdb
import pytest

from larkspur.plans import suite


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime) or not isinstance(v, dt.date):
        return str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in suite.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = suite.QUERIES[name](spark, sf_dir)
    want = duck.execute(suite.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(norm, r)) for r in want.fetchall())
