"""direct_links against its SQL where a chain of assignments comes back to the owner."""

import os

import duckdb

from verdigraph import catalog, facts
from verdigraph.operators import fixpoint

SF = "/root/testdata/sf0.001"

#: l_partkey, l_linenumber, l_orderkey, l_suppkey: variable 8 * l_partkey + l_linenumber has a link of
#: nature 1 + l_suppkey % 18 (12: element, 18: assigned) to 8 * l_partkey + 1 + l_orderkey % 7.
LINES = [
    (1, 1, 1, 11), (1, 2, 0, 17), (1, 1, 2, 17), (1, 2, 3, 17), (1, 4, 4, 17),  # 9 ∈ 10 → 9 → 11, 10 → 12 → 13
    (2, 1, 1, 11), (2, 2, 0, 17), (2, 1, 2, 17), (2, 2, 2, 17),  # as above, but 19 is also reached past the owner
    (3, 1, 1, 11), (3, 2, 2, 17), (3, 3, 1, 17),  # a cycle without the owner
    (None, 1, 1, 11),  # an unknown method: both ends are null
]


def test_direct_links_do_not_pass_their_owner(spark, tmp_path):
    for name in facts.TABLES:
        if name != "lineitem":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    rows = ", ".join(str(x).replace("None", "NULL") for x in LINES)
    con = duckdb.connect()
    con.execute(f"""
        COPY (SELECT l_partkey::BIGINT AS l_partkey, l_linenumber::INTEGER AS l_linenumber, l_orderkey::BIGINT AS l_orderkey, l_suppkey::BIGINT AS l_suppkey, 9.0::DOUBLE AS l_quantity
        FROM (VALUES {rows}) v(l_partkey, l_linenumber, l_orderkey, l_suppkey)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)
    """)
    for name in facts.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(f"SELECT src, dst FROM ({catalog.oracle_sql()['direct_links']})").fetchall()
    got = [(r.src, r.dst) for r in catalog.queries()["direct_links"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert set(got) == {(9, 10), (9, 12), (9, 13), (17, 18), (17, 19), (25, 26), (25, 27), (None, None)}


def test_pairs_through_their_owner_or_not(spark):
    edges = spark.createDataFrame([(2, 1), (1, 3), (3, 4), (5, 6)], "src long, dst long")
    start = spark.createDataFrame([(1, 2), (5, 5), (7, 2)], "owner long, node long")
    found = lambda **how: sorted(tuple(r) for r in fixpoint.pairs(edges, start, **how).collect())
    assert found() == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (5, 6), (7, 1), (7, 2), (7, 3), (7, 4)]
    assert found(through_owner=False) == [(1, 2), (5, 5), (5, 6), (7, 1), (7, 2), (7, 3), (7, 4)]
