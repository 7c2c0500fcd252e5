"""Registered queries against their SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()
NAMES = list(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(shown(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


def test_flagship(spark):
    row = entry_points.entry(spark).first()
    assert row["n_rows"] == 6000 and int(row["im"]) > 0
