"""Building the modification and null graphs: edges, seeds, taints, and what hierarchies add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators import components, fixpoint, lattice, links
from verdigraph.plans.registry import Facts, query


@query("SELECT DISTINCT c.callee * 10 + a.pos AS src, c.caller AS dst FROM call_site c JOIN call_arg a USING (site) WHERE NOT (a.pos = 1 AND a.var % 4 = 0)")
def mod_argument_edges(f: Facts) -> DataFrame:
    """Callee parameter to the caller's node of the argument; a disclaimed receiver gives none."""
    disclaimed = f.call_arg.where("pos = 1 and var % 4 = 0").select("site", "pos", "var")
    args = f.call_arg.join(disclaimed, ["site", "pos", "var"], "left_anti")
    return f.call_site.join(args, "site").select((F.col("callee") * 10 + F.col("pos")).alias("src"), F.col("caller").alias("dst")).distinct()


@query("SELECT DISTINCT coalesce(o.sub, c.callee) AS src, c.caller AS dst FROM call_site c JOIN method m ON m.m = c.callee LEFT JOIN override_edge o ON o.sup = c.callee AND m.is_abstract")
def mod_receiver_edges(f: Facts) -> DataFrame:
    """M2: callee, or an abstract callee's implementations, to the receiver."""
    abstract = f.method.where("is_abstract").select(F.col("m").alias("sup"))
    impl = f.override_edge.join(abstract, "sup").select(F.col("sup").alias("callee"), "sub")
    return f.call_site.join(impl, "callee", "left").select(F.coalesce("sub", "callee").alias("src"), F.col("caller").alias("dst")).distinct()


@query("SELECT DISTINCT a.m AS src, a.f AS dst FROM assignment a JOIN summary_link s ON s.m = a.m WHERE s.nature IN (16, 18)")
def mod_field_edges(f: Facts) -> DataFrame:
    """Method to field, by links that carry a modification."""
    carrying = f.summary_link.where("nature in (16, 18)").select("m").distinct()
    return f.assignment.join(carrying, "m").select(F.col("m").alias("src"), F.col("f").alias("dst")).distinct()


@query("SELECT sub AS src, sup AS dst FROM override_edge JOIN method ON m = sup WHERE is_abstract AND NOT coalesce(non_modifying, false)")
def mod_override_edges(f: Facts) -> DataFrame:
    """M6: override to overridden, abstract targets only, and none that is decided TRUE."""
    target = f.method.where("is_abstract and not coalesce(non_modifying, false)").select(F.col("m").alias("sup"))
    return f.override_edge.join(target, "sup").select(F.col("sub").alias("src"), F.col("sup").alias("dst"))


@query("""
SELECT m AS node, CASE WHEN is_abstract AND c.strength IS NOT NULL THEN 'contract' WHEN is_abstract AND m NOT IN (SELECT sup FROM override_edge) THEN 'none' WHEN is_abstract THEN 'implemented' WHEN a.m IS NOT NULL THEN 'assigns' END AS origin
FROM method LEFT JOIN contract c USING (m) LEFT JOIN (SELECT DISTINCT m FROM assignment) a USING (m) WHERE is_abstract OR a.m IS NOT NULL
""")
def mod_seeds(f: Facts) -> DataFrame:
    """Seeds with their origin."""
    sups = f.override_edge.select(F.col("sup").alias("m"), F.lit(True).alias("has_impl")).distinct()
    writes = f.assignment.select("m", F.lit(True).alias("writes")).distinct()
    x = f.method.join(f.contract.select("m", "strength"), "m", "left").join(sups, "m", "left").join(writes, "m", "left")
    origin = F.when(F.col("is_abstract") & F.col("strength").isNotNull(), "contract").when(F.col("is_abstract") & F.col("has_impl").isNull(), "none").when(F.col("is_abstract"), "implemented").when(F.col("writes"), "assigns")
    return x.select(F.col("m").alias("node"), origin.alias("origin")).where("origin is not null")


@query("SELECT c.site AS node, CASE WHEN s.m IS NULL THEN 'no summary' ELSE 'chain' END AS why FROM call_site c LEFT JOIN (SELECT DISTINCT m FROM summary_link) s ON s.m = c.callee WHERE s.m IS NULL OR c.site % 13 = 0")
def mod_taints(f: Facts) -> DataFrame:
    """Calls that taint, with the reason."""
    known = f.summary_link.select(F.col("m").alias("callee"), F.lit(True).alias("known")).distinct()
    x = f.call_site.join(known, "callee", "left").where("known is null or site % 13 = 0")
    return x.select(F.col("site").alias("node"), F.when(F.col("known").isNull(), "no summary").otherwise("chain").alias("why"))


@query("""
WITH RECURSIVE w(site, cur, depth) AS (SELECT site, site, 0 FROM receiver_call UNION ALL SELECT w.site, r.receiver, w.depth + 1 FROM w JOIN receiver_call r ON r.site = w.cur JOIN receiver_call t ON t.site = r.receiver)
SELECT w.site, r.var, w.depth FROM w JOIN receiver_call r ON r.site = w.cur WHERE r.receiver IS NULL OR r.receiver NOT IN (SELECT site FROM receiver_call)
""")
def receiver_chain(f: Facts) -> DataFrame:
    """The variable at the end of each call's chain of receivers, and the calls on the way."""
    calls = f.receiver_call
    known = calls.select(F.col("site").alias("receiver")).join(calls.where("receiver is not null").select("receiver").distinct(), "receiver")
    inner = calls.join(known, "receiver", "left_semi")
    up = links.ancestors(calls.select(F.col("site").alias("var"), F.lit(None).cast("long").alias("parent")).join(inner.select(F.col("site").alias("var"), "receiver"), "var", "left").select("var", F.col("receiver").alias("parent")))
    last = calls.join(inner.select("site"), "site", "left_anti").select(F.col("site").alias("anc"), F.col("var").alias("end"))
    return up.join(last, "anc").select(F.col("var").alias("site"), F.col("end").alias("var"), "depth")


@query("""
WITH RECURSIVE v AS (SELECT src AS var FROM base_link UNION SELECT dst FROM base_link),
p(var, node, deep) AS (SELECT var, var, false FROM v UNION SELECT p.var, b.dst, p.deep OR b.nature = 12 FROM p JOIN base_link b ON b.src = p.node WHERE b.nature IN (12, 13, 17, 18, 16, 9))
SELECT var, node, bool_and(deep) AS deep_only FROM p GROUP BY 1, 2
""")
def project_variable(f: Facts) -> DataFrame:
    """Nodes each variable projects to; deep-only if every way there goes through an element."""
    base = f.base_link
    start = base.select(F.col("src").alias("node")).union(base.select("dst")).distinct().select(F.col("node").alias("owner"), "node")
    steps = base.where("nature in (12, 13, 17, 18, 16, 9)")
    every = fixpoint.pairs(steps, start)
    flat = fixpoint.pairs(steps.where("nature <> 12"), start).withColumn("flat", F.lit(False))
    return every.join(flat, ["owner", "node"], "left").select(F.col("owner").alias("var"), "node", F.coalesce("flat", F.lit(True)).alias("deep_only"))


@query("""
WITH RECURSIVE a(t, anc) AS (SELECT t, parent FROM typ WHERE parent IS NOT NULL UNION SELECT a.t, typ.parent FROM a JOIN typ ON typ.t = a.anc WHERE typ.parent IS NOT NULL)
SELECT a.t, m.m FROM a JOIN method m ON m.owner = a.anc WHERE m.is_abstract AND NOT EXISTS (SELECT 1 FROM method c WHERE c.owner = a.t AND NOT c.is_abstract AND c.package = m.package)
""")
def uncovered_inherited(f: Facts) -> DataFrame:
    """Inherited abstract methods that no method of the type covers."""
    up = links.ancestors(f.typ.select(F.col("t").alias("var"), "parent")).where("depth > 0").select(F.col("var").alias("t"), F.col("anc").alias("owner"))
    wanted = up.join(f.method.where("is_abstract").select("m", "owner", "package"), "owner").select("t", "m", "package")
    own = f.method.where("not is_abstract").select(F.col("owner").alias("t"), "package").distinct()
    return wanted.join(own, ["t", "package"], "left_anti").select("t", "m")


@query("SELECT src, nature, dst FROM base_link WHERE src NOT IN (SELECT var FROM assign_fact GROUP BY 1 HAVING bool_and(non_null))")
def null_link_edges(f: Facts) -> DataFrame:
    """A link edge is dropped where its source is non-null at every assigning statement."""
    safe = f.assign_fact.groupBy(F.col("var").alias("src")).agg(lattice.all_or_false(F.col("non_null")).alias("safe")).where("safe")
    return f.base_link.join(safe, "src", "left_anti")


@query("SELECT f FROM field WHERE f IN (SELECT f FROM assignment WHERE m % 4 = 0) AND f NOT IN (SELECT f FROM assignment WHERE m % 4 <> 0)")
def stored_only_into_nullable(f: Facts) -> DataFrame:
    """Fields that only nullable values are stored into."""
    some = f.assignment.where("m % 4 = 0").select("f").distinct()
    return f.field.select("f").join(some, "f", "left_semi").join(f.assignment.where("m % 4 <> 0").select("f"), "f", "left_anti")


@query("""
WITH RECURSIVE e AS (SELECT sub AS a, sup AS b FROM override_edge UNION SELECT sup, sub FROM override_edge), g(a, b) AS (SELECT a, a FROM e UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b)
SELECT DISTINCT b AS node FROM g WHERE a IN (SELECT node FROM seed)
""")
def modified_by_identity(f: Facts) -> DataFrame:
    """The modified set closed over identity groups."""
    root = components.roots(f.override_edge.select(F.col("sub").alias("u"), F.col("sup").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
    grouped = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    hit = grouped.join(f.seed.select("node"), "node", "left_semi").select("root").distinct()
    return grouped.join(hit, "root").select("node").distinct()


@query("SELECT m, CASE WHEN bool_or(NOT unmodified) THEN 'modified' WHEN bool_or(unmodified IS NULL) THEN 'undecided' ELSE 'kept' END AS args, count(*) AS n FROM param GROUP BY 1")
def call_argument_effects(f: Facts) -> DataFrame:
    """What a call does to its arguments."""
    v = lattice.all_or_wait(F.col("unmodified"))
    return f.param.groupBy("m").agg(v.alias("v"), F.count(F.lit(1)).alias("n")).select("m", F.when(~F.col("v"), "modified").when(F.col("v").isNull(), "undecided").otherwise("kept").alias("args"), "n")


@query("SELECT m, max(CASE WHEN immutable = 3 THEN 2 WHEN immutable = 2 THEN 1 ELSE 0 END) AS level FROM reads JOIN field USING (f) GROUP BY 1")
def receiver_level(f: Facts) -> DataFrame:
    """The level of the receivers a method reads."""
    level = F.when(F.col("immutable") == 3, 2).when(F.col("immutable") == 2, 1).otherwise(0)
    return f.reads.join(f.field, "f").groupBy("m").agg(F.max(level).alias("level"))


@query("SELECT m, CASE WHEN bool_and(nature >= 8) THEN list_sort(list(DISTINCT to_pos)) END AS marks FROM summary_link GROUP BY 1")
def eventual_marks(f: Facts) -> DataFrame:
    """Labels only if every modification is excusable."""
    return f.summary_link.groupBy("m").agg(F.when(F.min(F.col("nature") >= 8), F.array_sort(F.collect_set("to_pos"))).alias("marks"))


@query("SELECT DISTINCT CASE WHEN d.kind = 'purchase' THEN o.sup ELSE o.sub END AS node FROM edit d JOIN override_edge o ON d.m IN (o.sub, o.sup) WHERE d.kind IN ('purchase', 'signup') AND CASE WHEN d.kind = 'purchase' THEN o.sub ELSE o.sup END = d.m")
def touched_vertices(f: Facts) -> DataFrame:
    """Distinct other ends of what a delta touches."""
    up = f.edit.where("kind = 'purchase'").select("m").distinct().join(f.override_edge, F.col("m") == F.col("sub")).select(F.col("sup").alias("node"))
    down = f.edit.where("kind = 'signup'").select("m").distinct().join(f.override_edge, F.col("m") == F.col("sup")).select(F.col("sub").alias("node"))
    return up.unionByName(down).distinct()


@query("SELECT a.m AS a, b.m AS b, a.f FROM reads a JOIN reads b ON a.f = b.f AND a.m < b.m")
def local_composition(f: Facts) -> DataFrame:
    """Two-hop links through one shared variable, of the weakest nature."""
    b = f.reads.select("f", F.col("m").alias("b"))
    return f.reads.select("f", F.col("m").alias("a")).join(b, "f").where("a < b").select("a", "b", "f")
