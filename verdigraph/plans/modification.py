"""Modification analysis: reachability of modifications, its causes, and the verdicts it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators import components, fixpoint, lattice
from verdigraph.plans.registry import Facts, query

_LEVEL = """
WITH RECURSIVE r(node, level) USING KEY (node) AS (
  SELECT node, 0 FROM seed
  UNION
  SELECT DISTINCT c.dst, r.level + 1 FROM r JOIN call_edge c ON r.node = c.src LEFT JOIN recurring.r k ON k.node = c.dst WHERE k.node IS NULL
)"""


@query("WITH RECURSIVE r(node) AS (SELECT node FROM seed UNION SELECT c.dst FROM r JOIN call_edge c ON r.node = c.src) SELECT node FROM r")
def mod_reach(f: Facts) -> DataFrame:
    """Everything a modification reaches."""
    return fixpoint.reach(f.call_edge, f.seed).select("node")


@query("WITH RECURSIVE r(node) AS (SELECT node FROM seed WHERE structural UNION SELECT c.dst FROM r JOIN call_edge c ON r.node = c.src WHERE NOT c.deep_only) SELECT node FROM r")
def mod_reach_structural(f: Facts) -> DataFrame:
    """Structural seeds along edges that are not deep-only."""
    return fixpoint.reach(f.call_edge.where("not deep_only"), f.seed.where("structural")).select("node")


@query("""
WITH RECURSIVE a(node) AS (SELECT node FROM seed UNION SELECT c.dst FROM a JOIN call_edge c ON a.node = c.src),
s(node) AS (SELECT node FROM seed WHERE structural UNION SELECT c.dst FROM s JOIN call_edge c ON s.node = c.src WHERE NOT c.deep_only)
SELECT node FROM a WHERE node NOT IN (SELECT node FROM s)
""")
def mod_deep_only(f: Facts) -> DataFrame:
    """Reached, but not structurally."""
    every = fixpoint.reach(f.call_edge, f.seed).select("node")
    return every.join(fixpoint.reach(f.call_edge.where("not deep_only"), f.seed.where("structural")).select("node"), "node", "left_anti")


@query("WITH RECURSIVE r(node) AS (SELECT node FROM seed UNION SELECT c.dst FROM r JOIN call_edge c ON r.node = c.src WHERE r.node NOT IN (SELECT node FROM cut)) SELECT node FROM r")
def mod_reach_cut(f: Facts) -> DataFrame:
    """R17 with absorbing nodes: methods of immutable type are reached and pass nothing on."""
    return fixpoint.reach(f.call_edge, f.seed, f.cut).select("node")


@query(_LEVEL + " SELECT node, level FROM r")
def mod_level(f: Facts) -> DataFrame:
    """Fewest steps from a seed."""
    return fixpoint.reach(f.call_edge, f.seed)


@query(_LEVEL + " SELECT a.node, a.level, min(b.node) AS cause FROM r a LEFT JOIN call_edge c ON c.dst = a.node LEFT JOIN r b ON b.node = c.src AND b.level = a.level - 1 GROUP BY 1, 2")
def mod_cause(f: Facts) -> DataFrame:
    """What is modified, how far from a seed, and by which caller."""
    return fixpoint.causes(f.call_edge, fixpoint.reach(f.call_edge, f.seed))


@query(_LEVEL + """, p AS (SELECT a.node, a.level, min(b.node) AS cause FROM r a LEFT JOIN call_edge c ON c.dst = a.node LEFT JOIN r b ON b.node = c.src AND b.level = a.level - 1 GROUP BY 1, 2),
w(elem, pos, node) AS (SELECT node, 0, node FROM p UNION ALL SELECT w.elem, w.pos + 1, p.cause FROM w JOIN p ON p.node = w.node WHERE p.cause IS NOT NULL AND w.pos + 1 < 6)
SELECT elem, pos, node FROM w""")
def culprit_chain(f: Facts) -> DataFrame:
    """The first six steps of the cause chain of every reached method."""
    caused = fixpoint.causes(f.call_edge, fixpoint.reach(f.call_edge, f.seed))
    return fixpoint.cause_chain(caused, caused.select("node"), 6)


def _after(f: Facts) -> DataFrame:
    """Verdicts before and after the cutover."""
    reached = fixpoint.reach(f.call_edge, f.seed).select(F.col("node").alias("m"), F.lit(True).alias("hit"))
    contracts = f.contract.select("m", F.lit(True).alias("bound"))
    taints = f.edit.where("kind = 'error'").select("m", F.lit(True).alias("taint")).distinct()
    all_ = f.method.join(reached, "m", "left").join(contracts, "m", "left").join(taints, "m", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = lattice.cutover(flag("hit"), flag("bound"), F.col("immutable_type"), F.col("non_modifying"), flag("taint"))
    return all_.select("m", flag("hit").alias("hit"), F.col("non_modifying").alias("before"), verdict.alias("verdict"))


_AFTER = """
WITH RECURSIVE r(node) AS (SELECT node FROM seed UNION SELECT c.dst FROM r JOIN call_edge c ON r.node = c.src),
x AS (SELECT m, m IN (SELECT node FROM r) AS hit, m IN (SELECT m FROM contract) AS bound, immutable_type AS imm, non_modifying AS old, m IN (SELECT m FROM edit WHERE kind = 'error') AS taint FROM method),
v AS (SELECT m, hit, old AS before, CASE WHEN hit AND (bound OR imm) THEN old WHEN hit AND (old IS NULL OR old) THEN false
  WHEN NOT hit AND old IS NULL AND (imm OR NOT taint) THEN true WHEN NOT hit AND NOT old AND NOT taint THEN true ELSE old END AS verdict FROM x)"""


@query(_AFTER + " SELECT m, before, verdict FROM v")
def verdict_cutover(f: Facts) -> DataFrame:
    """V4: the verdict written after reachability, by its eight outcomes."""
    return _after(f).select("m", "before", "verdict")


@query(_AFTER + " SELECT m, CASE WHEN hit THEN 'divergence' ELSE 'reverse' END AS kind FROM v WHERE hit AND before OR NOT hit AND NOT before")
def divergence(f: Facts) -> DataFrame:
    """Frozen unmodified but reached, and frozen modified but not reached."""
    v = _after(f)
    return v.where("hit and before or not hit and not before").select("m", F.when(F.col("hit"), "divergence").otherwise("reverse").alias("kind"))


@query(_AFTER + " SELECT CASE WHEN before IS NULL THEN 'undecided' WHEN before THEN 'unmodified' ELSE 'modified' END AS key, count(*) AS n FROM v WHERE before IS DISTINCT FROM verdict GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def change_census_top10(f: Facts) -> DataFrame:
    """Changes per former verdict, the ten most frequent."""
    key = F.when(F.col("before").isNull(), "undecided").when(F.col("before"), "unmodified").otherwise("modified")
    return _after(f).where("not (before <=> verdict)").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query(_AFTER + " SELECT m FROM v WHERE verdict IS NULL")
def undecided_methods(f: Facts) -> DataFrame:
    """What is still undecided at the certification point."""
    return _after(f).where("verdict is null").select("m")


@query("""
WITH RECURSIVE e AS (SELECT sub AS a, sup AS b FROM override_edge UNION SELECT sup, sub FROM override_edge),
r(n, root) USING KEY (n) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b AS n, min(r.root) AS root FROM r JOIN e ON e.a = r.n JOIN recurring.r k ON k.n = e.b WHERE r.root < k.root GROUP BY e.b)
SELECT n AS node, root FROM r WHERE n <> root
""")
def override_family(f: Facts) -> DataFrame:
    """Families of methods that override each other, named by their least member."""
    return components.roots(f.override_edge.select(F.col("sub").alias("u"), F.col("sup").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))


@query("""
WITH RECURSIVE w(node, wave) AS (SELECT m, 0 FROM method UNION SELECT o.sub, w.wave + 1 FROM w JOIN override_edge o ON o.sup = w.node)
SELECT node, max(wave) AS wave FROM w GROUP BY 1
""")
def override_waves(f: Facts) -> DataFrame:
    """Waves in which every method comes after all that it depends on."""
    nodes = f.method.select(F.col("m").alias("node"))
    alone = nodes.select("node", F.col("node").alias("root"))
    return fixpoint.waves(f.override_edge.select(F.col("sub").alias("src"), F.col("sup").alias("dst")), nodes, alone)


_CONSTRUCTION = """
WITH RECURSIVE ctor AS (SELECT m FROM method WHERE m % 20 = 0), outside AS (SELECT m FROM method WHERE NOT is_private AND m % 20 <> 0),
c(m) AS (SELECT m FROM ctor UNION SELECT e.dst FROM c JOIN call_edge e ON e.src = c.m),
o(m) AS (SELECT m FROM outside UNION SELECT e.dst FROM o JOIN call_edge e ON e.src = o.m WHERE e.dst % 20 <> 0),
part_of AS (SELECT m FROM c WHERE m NOT IN (SELECT m FROM o))"""


def _construction(f: Facts) -> DataFrame:
    starts = f.method.select(F.col("m").alias("node"), "is_private")
    inside = fixpoint.reach(f.call_edge, starts.where("node % 20 = 0").select("node")).select("node")
    outside = fixpoint.reach(f.call_edge.where("dst % 20 <> 0"), starts.where("not is_private and node % 20 <> 0").select("node"))
    return inside.join(outside.select("node"), "node", "left_anti").select(F.col("node").alias("m"))


@query(_CONSTRUCTION + " SELECT m FROM part_of")
def part_of_construction(f: Facts) -> DataFrame:
    """Called from constructors, and from nowhere outside of construction."""
    return _construction(f)


@query(_CONSTRUCTION + " SELECT f FROM field WHERE (is_final OR is_private) AND f NOT IN (SELECT f FROM assignment WHERE m NOT IN (SELECT m FROM part_of))")
def final_field(f: Facts) -> DataFrame:
    """Final or private, and never assigned outside of construction."""
    late = f.assignment.join(_construction(f), "m", "left_anti").select("f").distinct()
    return f.field.where("is_final or is_private").select("f").join(late, "f", "left_anti")


@query(_CONSTRUCTION + """
SELECT x.f, CASE WHEN min(CASE WHEN d.non_modifying THEN 1 WHEN NOT d.non_modifying THEN 0 END) = 0 THEN false WHEN count(*) FILTER (d.m IS NOT NULL AND d.non_modifying IS NULL) > 0 THEN NULL ELSE true END AS unmodified
FROM field x LEFT JOIN (SELECT a.f, m.m, m.non_modifying FROM assignment a JOIN method m USING (m) WHERE m.m NOT IN (SELECT m FROM part_of)) d ON d.f = x.f GROUP BY 1
""")
def field_unmodified(f: Facts) -> DataFrame:
    """FALSE by one modifying method outside construction, else NULL while one is undecided."""
    users = f.assignment.join(_construction(f), "m", "left_anti").join(f.method.select("m", "non_modifying"), "m")
    folded = users.groupBy("f").agg(lattice.all_or_wait(F.col("non_modifying")).alias("unmodified"), F.lit(True).alias("used"))
    return f.field.select("f").join(folded, "f", "left").select("f", F.when(F.col("used"), F.col("unmodified")).otherwise(F.lit(True)).alias("unmodified"))


@query("""
WITH RECURSIVE s(owner, node) AS (SELECT DISTINCT owner, m FROM assignment JOIN field USING (f) UNION SELECT s.owner, o.sup FROM s JOIN override_edge o ON o.sub = s.node)
SELECT owner, node FROM s
""")
def static_state(f: Facts) -> DataFrame:
    """Owners whose static state each method touches, carried along calls."""
    start = f.assignment.join(f.field, "f").select("owner", F.col("m").alias("node"))
    return fixpoint.pairs(f.override_edge.select(F.col("sub").alias("src"), F.col("sup").alias("dst")), start)


@query("""
WITH old AS (SELECT m AS elem_id, CASE m % 4 WHEN 0 THEN NULL ELSE m % 4 END AS before FROM method),
neu AS (SELECT m AS elem_id, max(strength) AS after FROM contract GROUP BY 1), j AS (SELECT elem_id, before, after, before IS NOT NULL AND after IS NOT NULL AND before <> after AS change FROM old FULL JOIN neu USING (elem_id))
SELECT elem_id, CASE WHEN after IS NULL OR change AND after <= before THEN before ELSE after END AS value, change AND after <= before AS refused FROM j
""")
def property_upsert(f: Facts) -> DataFrame:
    """V1 and V2: write-once properties that only rise."""
    return _upserted(f).select("elem_id", "value", "refused")


def _upserted(f: Facts) -> DataFrame:
    key = F.lit("level").alias("key")
    old = f.method.select(F.col("m").alias("elem_id"), key, F.when(F.col("m") % 4 > 0, F.col("m") % 4).alias("value"))
    new = f.contract.groupBy(F.col("m").alias("elem_id")).agg(F.max("strength").cast("long").alias("value")).select("elem_id", key, "value")
    return lattice.upsert(old, new, F.col("after") > F.col("before"))


@query("""
WITH old AS (SELECT m AS elem_id, CASE m % 4 WHEN 0 THEN NULL ELSE m % 4 END AS before FROM method), neu AS (SELECT m AS elem_id, max(strength) AS after FROM contract GROUP BY 1)
SELECT 'level' AS key, count(*) AS n FROM old JOIN neu USING (elem_id) WHERE after < before
""")
def refused_downgrades(f: Facts) -> DataFrame:
    """Refused overwrites per property."""
    return _upserted(f).where("refused").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE g(m) AS (SELECT m FROM method WHERE is_private OR m % 3 = 0 EXCEPT
  SELECT NULL), a AS (SELECT src AS m, dst AS needs FROM call_edge), z(m) AS (
  SELECT m FROM method WHERE NOT (is_private OR m % 3 = 0) UNION SELECT a.m FROM z JOIN a ON a.needs = z.m)
SELECT m AS node FROM g WHERE m NOT IN (SELECT m FROM z)
""")
def eventual_cluster(f: Facts) -> DataFrame:
    """Greatest fixpoint; a member goes when something it assumes is no member."""
    members = f.method.where("is_private or m % 3 = 0").select(F.col("m").alias("node"))
    return fixpoint.greatest(members, f.call_edge.select(F.col("src").alias("node"), F.col("dst").alias("needs")))


@query("""
WITH RECURSIVE r(node) AS (SELECT 7::BIGINT UNION SELECT c.dst FROM r JOIN call_edge c ON r.node = c.src WHERE r.node % 5 <> 0)
SELECT node, node % 5 = 0 AS stub FROM r
""")
def isolate(f: Facts) -> DataFrame:
    """The sub-graph one element needs, with a mark for boundary nodes that become stubs."""
    stubs = f.method.where("m % 5 = 0").select(F.col("m").alias("node"))
    seed = f.spark.createDataFrame([(7,)], "node long")
    return fixpoint.reach(f.call_edge, seed, stubs).select("node", (F.col("node") % 5 == 0).alias("stub"))
