"""Verdicts that wait for other verdicts: views, lifted elements, and rounds of preconditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import algebra
from verdigraph.operators import fixpoint, links
from verdigraph.plans.linking import _ALGEBRA
from verdigraph.plans.registry import Facts, query

_R = algebra.RANK
#: Outer rounds of the null pass; a fixed value.
ROUNDS = 5


@query("""
WITH RECURSIVE base AS (SELECT m FROM returned GROUP BY m HAVING bool_and(kind = 'null') OR bool_or(kind = 'other') OR bool_or(kind = 'call' AND callee NOT IN (SELECT m FROM returned))),
f(m) AS (SELECT m FROM base UNION SELECT r.m FROM f JOIN returned r ON r.kind = 'call' AND r.callee = f.m),
e AS (SELECT DISTINCT m AS a, callee AS b FROM returned WHERE kind = 'call' AND m NOT IN (SELECT m FROM f)),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
waits AS (SELECT x.a FROM c x JOIN c y ON y.a = y.b AND (x.b = y.a OR x.a = y.a))
SELECT DISTINCT m, CASE WHEN m IN (SELECT m FROM f) THEN false WHEN m NOT IN (SELECT a FROM waits) THEN true END AS is_view FROM returned
""")
def unmodifiable_view(f: Facts) -> DataFrame:
    """Whether all that a method returns is unmodifiable: wrapped, null, or from a method of which that is true.

    False if it returns only null, anything else, or from a method of which it is false; null (undecided)
    on a cycle of calls and above one.
    """
    r = f.returned
    methods = r.groupBy(F.col("m").alias("node")).agg(F.min(F.col("kind") == "null").alias("only_null"), F.max(F.col("kind") == "other").alias("other"))
    calls = r.where("kind = 'call'").select(F.col("m").alias("node"), F.col("callee").alias("needs")).distinct()
    unknown = calls.join(methods.select(F.col("node").alias("needs")), "needs", "left_anti").select("node")
    base = methods.where("only_null or other").select("node").unionByName(unknown)
    no = fixpoint.reach(calls.select(F.col("needs").alias("src"), F.col("node").alias("dst")), base).select("node", F.lit(False).alias("no"))
    rest = methods.select("node").join(no, "node", "left_anti")
    yes = fixpoint.well_founded(rest, calls.join(rest, "node", "left_semi")).select("node", F.lit(True).alias("yes"))
    return methods.select("node").join(no, "node", "left").join(yes, "node", "left").select(F.col("node").alias("m"), F.coalesce("no", "yes").alias("is_view"))


@query(f"""
WITH RECURSIVE {_ALGEBRA}, hidden AS (SELECT DISTINCT var FROM variable WHERE kind = 'virtual_mod'),
up(src, nature, dst, lifted) AS (SELECT src, nature, dst, false FROM base_link UNION SELECT u.src, k.t, e.whole, true FROM up u JOIN local_element e ON e.var = u.dst JOIN combine k ON k.r = u.nature AND k.s = {_R['∈']}),
down(src, nature, dst, lifted) AS (SELECT * FROM up WHERE dst NOT IN (SELECT var FROM local_element) UNION SELECT e.whole, k.t, d.dst, true FROM down d JOIN local_element e ON e.var = d.src JOIN combine k ON k.r = {_R['∋']} AND k.s = d.nature)
SELECT DISTINCT src, nature, dst FROM down WHERE src NOT IN (SELECT var FROM local_element) AND src <> dst AND (NOT lifted OR (src IN (SELECT var FROM hidden)) = (dst IN (SELECT var FROM hidden)))
""")
def lifted_elements(f: Facts) -> DataFrame:
    """Links at local indices of arrays, as links of the arrays."""
    return links.lift_elements(f.base_link, f.local_element, f.variable.where("kind = 'virtual_mod'").select("var"), algebra.table(f.spark), _R["∈"], _R["∋"])


@query(f"""
WITH RECURSIVE p(m, pos, n) AS (SELECT m, pos, 1 FROM precondition UNION SELECT c.caller, o.own, p.n + 1 FROM p JOIN call_site c ON c.callee = p.m JOIN own_param o ON o.site = c.site AND o.pos = p.pos WHERE p.n < {ROUNDS})
SELECT DISTINCT m, pos FROM p
""")
def precondition_rounds(f: Facts) -> DataFrame:
    """A parameter handed to a precondition becomes one, by outer rounds of which there are five at most."""
    direct, passed = f.precondition.select("m", "pos"), f.call_site.join(f.own_param, "site").select("callee", "pos", "caller", "own")

    def once(known: DataFrame) -> DataFrame:
        spread = passed.join(known.withColumnRenamed("m", "callee"), ["callee", "pos"]).select(F.col("caller").alias("m"), F.col("own").alias("pos"))
        return direct.unionByName(spread)

    return fixpoint.outer_rounds(once, direct.limit(0), ROUNDS)
