"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from verdigraph import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    """All but an ordered fold, which tests/test_operators.py holds against a recursive version."""
    assert QUERIES.keys() == ORACLES.keys() | {"always_escapes"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in found), key=repr)
    assert rows(df.select(columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
