"""Fact tables: explicit schemas, and deterministic fact views over the star-schema test tables.

The engine's input is fact tables, never source text. ``VIEWS`` maps each fact to SQL that Spark and
any ANSI engine read alike, so queries and their oracles start from the same facts.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the fact tables, as DDL; nothing is ever inferred from data. NULL means undecided.
SCHEMAS = {
    "element": "elem_id bigint, kind string, owner bigint, ord int, package string",
    "call_edge": "src bigint, dst bigint, deep_only boolean",
    "override_edge": "sub bigint, sup bigint",
    "property": "elem_id bigint, key string, value string, origin string, round int",
    "link": "src bigint, nature int, dst bigint",
    "finding": "category string, elem_id bigint, level string, text string",
}

_N = "(SELECT count(*) FROM part)"
_T = "(SELECT count(*) FROM supplier)"
_F = "(SELECT count(*) FROM customer)"
_VAR = "(l_partkey % (SELECT 1 + count(*) // 8 FROM part)) * 8"

VIEWS = {
    # Methods belong to types; verdicts are three-valued.
    "method": f"SELECT p_partkey AS m, p_partkey % {_T} AS owner, p_size % 5 = 0 AS is_private, p_size % 11 = 0 AS is_abstract, p_size % 7 = 0 AS immutable_type, "
    "CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS non_modifying, p_partkey % 3 AS independent, p_type AS package FROM part",
    "param": f"SELECT o_orderkey AS p, o_orderkey % {_N} AS m, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS unmodified, o_custkey AS linked_field FROM orders",
    "field": f"SELECT c_custkey AS f, c_custkey % {_T} AS owner, c_nationkey % 2 = 0 AS is_final, c_mktsegment = 'BUILDING' AS is_private, "
    "CASE WHEN c_nationkey % 3 = 0 THEN true WHEN c_nationkey % 3 = 1 THEN false END AS unmodified, c_nationkey % 4 AS immutable FROM customer",
    "typ": "SELECT s_suppkey AS t, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent, s_nationkey % 4 AS hint FROM supplier",
    "call_edge": f"SELECT l_partkey AS src, l_orderkey % {_N} AS dst, min(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS deep_only FROM lineitem WHERE l_quantity >= 40 AND l_discount >= 0.08 GROUP BY 1, 2",
    "seed": "SELECT l_partkey AS node, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 AS structural FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount = 0.1 AND l_tax >= 0.07 GROUP BY 1",
    "cut": "SELECT p_partkey AS node FROM part WHERE p_size % 7 = 0",
    "override_edge": f"SELECT DISTINCT l_partkey AS sub, l_orderkey % {_N} AS sup FROM lineitem WHERE l_quantity <= 2 AND l_discount >= 0.08 AND l_orderkey % {_N} < l_partkey",
    "assignment": f"SELECT DISTINCT l_orderkey % {_F} AS f, l_partkey AS m FROM lineitem WHERE l_quantity <= 2",
    "reads": f"SELECT DISTINCT l_orderkey % {_F} AS f, l_partkey AS m FROM lineitem WHERE l_quantity BETWEEN 3 AND 6",
    "call_site": f"SELECT DISTINCT l_orderkey AS site, l_orderkey % {_N} AS caller, l_partkey AS callee FROM lineitem WHERE l_quantity = 7",
    "call_arg": "SELECT DISTINCT l_orderkey AS site, l_linenumber AS pos, l_suppkey AS var FROM lineitem WHERE l_quantity = 7",
    "summary_link": "SELECT DISTINCT l_partkey AS m, l_linenumber AS from_pos, 1 + l_suppkey % 18 AS nature, (l_linenumber + l_suppkey) % 7 + 1 AS to_pos FROM lineitem WHERE l_quantity = 8",
    # Local variables of a method are its number times 8 and their place in it, so links stay in methods.
    "base_link": f"SELECT DISTINCT {_VAR} + l_linenumber AS src, 1 + l_suppkey % 18 AS nature, {_VAR} + 1 + l_orderkey % 7 AS dst FROM lineitem WHERE l_quantity = 9 AND l_linenumber <> 1 + l_orderkey % 7",
    "assign_fact": f"SELECT DISTINCT l_orderkey AS stmt, {_VAR} + l_linenumber AS var, l_returnflag <> 'R' AS non_null FROM lineitem WHERE l_quantity BETWEEN 9 AND 10",
    "receiver_call": "SELECT o_orderkey AS site, CASE WHEN o_orderstatus <> 'P' AND o_orderkey > 0 THEN o_orderkey // 3 END AS receiver, o_custkey AS var FROM orders",
    # What an extractor says of variables, null sources, library members, lambdas and statements.
    "variable": f"SELECT DISTINCT {_VAR} + l_linenumber AS var, {_VAR} // 8 AS m, CASE l_linenumber WHEN 1 THEN 'return' WHEN 2 THEN 'param' WHEN 3 THEN 'param' WHEN 4 THEN 'field' WHEN 5 THEN 'local' WHEN 6 THEN 'virtual' ELSE 'virtual_mod' END AS kind FROM lineitem",
    "constant": f"SELECT {_VAR} + l_linenumber AS var, min(l_suppkey) AS value FROM lineitem WHERE l_quantity = 10 GROUP BY 1 HAVING count(*) = 1",
    "cast_site": f"SELECT DISTINCT {_VAR} + l_linenumber AS a, {_VAR} + 1 + l_orderkey % 7 AS b FROM lineitem WHERE l_quantity BETWEEN 9 AND 12 AND l_returnflag = 'R'",
    "modified_var": f"SELECT DISTINCT {_VAR} + l_linenumber AS var FROM lineitem WHERE l_quantity = 13 AND l_returnflag = 'A'",
    "lambda_binding": f"SELECT l_orderkey AS site, l_linenumber AS pos, min(l_partkey) AS fn FROM lineitem WHERE l_quantity = 7 AND l_returnflag <> 'N' GROUP BY 1, 2",
    "dims": f"SELECT DISTINCT l_partkey AS m, l_linenumber AS pos, l_suppkey % 3 AS arrays, l_orderkey % 3 AS arrays_source, l_linestatus = 'F' AS reverse FROM lineitem WHERE l_quantity = 14",
    "type_arg": "SELECT DISTINCT s_suppkey AS t, s_suppkey // 2 AS arg, s_nationkey % 2 = 0 AS invariant FROM supplier WHERE s_suppkey > 0",
    "null_source": f"SELECT DISTINCT o_orderkey % {_N} AS node, CASE o_orderpriority WHEN '1-URGENT' THEN 'literal' WHEN '2-HIGH' THEN 'default value' WHEN '3-MEDIUM' THEN 'null test' WHEN '4-NOT SPECIFIED' THEN 'library' ELSE 'argument' END AS source, o_orderstatus = 'P' AS in_test FROM orders WHERE o_totalprice < 30000",
    "library": "SELECT p_partkey AS m, CASE p_size % 4 WHEN 0 THEN 'nullable' WHEN 1 THEN 'view of argument' WHEN 2 THEN 'stream' ELSE 'non-null' END AS returns, p_size < 4 AS is_value_of FROM part WHERE p_size < 20",
    "precondition": f"SELECT DISTINCT l_partkey AS m, l_linenumber AS pos FROM lineitem WHERE l_quantity = 15",
    "array_init": f"SELECT {_VAR} + l_linenumber AS var, max(l_suppkey % 9) AS size, count(DISTINCT l_orderkey % 9) AS filled FROM lineitem WHERE l_quantity = 16 GROUP BY 1",
    "returned": f"SELECT DISTINCT l_partkey AS m, CASE WHEN l_linenumber = 1 THEN 'other' WHEN l_linenumber = 2 THEN 'null' WHEN l_linenumber <= 4 THEN 'call' ELSE 'wrapped' END AS kind, CASE WHEN l_linenumber BETWEEN 3 AND 4 THEN l_orderkey % {_N} END AS callee FROM lineitem WHERE l_quantity BETWEEN 17 AND 20",
    "local_element": f"SELECT DISTINCT {_VAR} + 5 AS var, {_VAR} + 4 AS whole FROM lineitem WHERE l_quantity = 21 UNION SELECT DISTINCT {_VAR} + 6, {_VAR} + 5 FROM lineitem WHERE l_quantity = 22",
    "own_param": "SELECT DISTINCT l_orderkey AS site, l_linenumber AS pos, 1 + l_suppkey % 7 AS own FROM lineitem WHERE l_quantity = 7",
    "statement": "SELECT o_orderkey AS s, CASE WHEN o_orderkey > 0 THEN o_orderkey // 3 END AS parent, CASE WHEN o_orderstatus = 'O' THEN 'return' WHEN o_orderstatus = 'P' THEN 'break' ELSE 'plain' END AS leaf, o_orderpriority <= '2-HIGH' AS is_loop, o_orderpriority = '1-URGENT' AS infinite FROM orders",
    "ignored": "SELECT c_custkey AS f FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "production": "SELECT p_partkey AS m FROM part WHERE p_size % 9 <> 0",
    "stmt": "SELECT DISTINCT l_linenumber || '.' || (l_suppkey % 4) || '.' || (CAST(l_quantity AS INT) % 3) AS idx, CAST(l_linenumber AS VARCHAR(9)) AS scope FROM lineitem",
    "slice": "SELECT DISTINCT l_partkey AS container, l_linenumber AS slice, l_suppkey % 40 AS target FROM lineitem WHERE l_linenumber <= 3",
    "contract": "SELECT p_partkey AS m, p_size % 4 AS strength FROM part WHERE p_size % 6 < 2",
    "edit": "SELECT event_id % (SELECT count(*) FROM part) AS m, event_type AS kind, user_id AS who, event_id AS seq FROM events",
}


TABLES = ("supplier", "part", "customer", "orders", "lineitem", "events")


def register(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Names of temporary views of the star-schema tables of ``sf_dir``; they are made once a session."""
    tag = f"{zlib.crc32(sf_dir.encode()):08x}"
    names = {name: f"verdigraph_{tag}_{name}" for name in TABLES}
    for name, view in names.items():
        if not spark.catalog.tableExists(view):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    return names


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fact ``name`` over the tables of ``sf_dir``."""
    names = register(spark, sf_dir)
    sql = re.sub(rf"\b({'|'.join(TABLES)})\b", lambda m: names[m[0]], VIEWS[name])
    return spark.sql(sql.replace("//", "DIV"))


def oracle(sql: str) -> str:
    """``sql`` with each fact view it names as a common table expression before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{body}"
    return f"WITH {head} {body}" if head else body
