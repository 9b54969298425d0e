"""Every registered query with reference SQL, compared with DuckDB on the smallest sample."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("sample tables are not here")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return names, sorted((tuple(clean(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, DATA).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_registry():
    assert set(ORACLES) <= set(entry.queries()) and len(entry.queries()) > 100
