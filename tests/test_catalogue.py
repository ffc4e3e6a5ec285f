"""Every registered query against its SQL in DuckDB on a small scale."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    if name == "pipeline" or name.startswith("op"):
        pytest.importorskip("verdigris.llm")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    assert sorted(duck.sql(sql).columns) == columns
    want = sorted(tuple(map(shown, r)) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
