"""Link analysis: composition, closure, call sites, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import algebra, scalars
from verdigraph.operators import components, fixpoint, links, lattice
from verdigraph.plans.registry import Facts, query

_ALGEBRA = "combine(r, s, t) AS (VALUES " + ", ".join(map(str, algebra.entries())) + "), mirror(nature, reverse) AS (VALUES " + ", ".join(f"({algebra.RANK[a]}, {algebra.RANK[algebra.REVERSE[a]]})" for a in algebra.NATURES) + ")"
_BASE = "sym AS (SELECT src, nature, dst FROM base_link UNION SELECT dst, reverse, src FROM base_link JOIN mirror USING (nature))"
_CLOSURE = f"""WITH RECURSIVE {_ALGEBRA}, {_BASE}, f(a, l, b) USING KEY (a, l, b) AS (SELECT src, nature, dst FROM sym UNION (
  WITH n AS (SELECT DISTINCT x.a, c.t AS l, y.b FROM f x JOIN recurring.f y ON x.b = y.a JOIN combine c ON c.r = x.l AND c.s = y.l WHERE x.a <> y.b
    UNION SELECT DISTINCT x.a, c.t, y.b FROM recurring.f x JOIN f y ON x.b = y.a JOIN combine c ON c.r = x.l AND c.s = y.l WHERE x.a <> y.b),
  m AS (SELECT a, l, b FROM n UNION SELECT b, reverse, a FROM n JOIN mirror ON nature = l)
  SELECT m.a, m.l, m.b FROM m LEFT JOIN recurring.f k ON k.a = m.a AND k.l = m.l AND k.b = m.b WHERE k.a IS NULL))"""


def _closed(f: Facts) -> DataFrame:
    base = f.base_link.withColumn("nature", F.col("nature").cast("int"))
    return fixpoint.labelled_closure(base, algebra.table(f.spark), algebra.natures(f.spark).select("nature", "reverse"))


@query(f"WITH {_ALGEBRA} SELECT DISTINCT x.src, t AS nature, y.dst FROM base_link x JOIN base_link y ON x.dst = y.src JOIN combine ON r = x.nature AND s = y.nature WHERE x.src <> y.dst")
def link_compose_once(f: Facts) -> DataFrame:
    """Links of two steps."""
    return links.compose(f.base_link, f.base_link, algebra.table(f.spark))


@query(_CLOSURE + " SELECT a AS src, l AS nature, b AS dst FROM f")
def link_closure(f: Facts) -> DataFrame:
    """All derivable labels of all pairs, with their reverses."""
    return _closed(f)


@query(_CLOSURE + " SELECT a AS src, b AS dst, max(l) AS nature FROM f GROUP BY 1, 2")
def link_best(f: Facts) -> DataFrame:
    """The strongest derivable label of each pair."""
    return links.best(_closed(f))


@query(_CLOSURE + " SELECT a AS src, l AS nature, b AS dst FROM f WHERE l >= 8")
def links_of_primary(f: Facts) -> DataFrame:
    """The links of each primary variable from the closure, filtered by strength."""
    return _closed(f).where("nature >= 8")


@query(_CLOSURE.replace("base_link", "kept").replace(f"{_ALGEBRA},", f"{_ALGEBRA}, kept AS (SELECT * FROM base_link WHERE (src + dst) % 3 <> 0),", 1) + " SELECT a AS src, l AS nature, b AS dst FROM f")
def link_retraction(f: Facts) -> DataFrame:
    """The closure after base links were withdrawn."""
    base = f.base_link.withColumn("nature", F.col("nature").cast("int"))
    return fixpoint.retract(base, base.where("(src + dst) % 3 = 0"), algebra.table(f.spark), algebra.natures(f.spark).select("nature", "reverse"))


@query(f"WITH {_ALGEBRA} SELECT src, nature, dst FROM base_link x WHERE NOT (src > dst AND EXISTS (SELECT 1 FROM base_link y JOIN mirror m ON m.nature = y.nature WHERE y.dst = x.src AND y.src = x.dst AND m.reverse = x.nature))")
def link_without_reverses(f: Facts) -> DataFrame:
    """Of a link and its reverse only one is kept."""
    base = f.base_link.withColumn("nature", F.col("nature").cast("int"))
    return links.without_reverses(base, algebra.natures(f.spark).select("nature", "reverse"))


@query("SELECT x.sub AS src, 8 AS nature, x.sup AS dst FROM override_edge x WHERE NOT EXISTS (SELECT 1 FROM override_edge a JOIN override_edge b ON a.sup = b.sub WHERE a.sub = x.sub AND b.sup = x.sup)")
def redundant_links(f: Facts) -> DataFrame:
    """Links that two others of a transitive nature imply are suppressed."""
    return links.transitive_reduction(f.override_edge.select(F.col("sub").alias("src"), F.lit(8).alias("nature"), F.col("sup").alias("dst")))


@query("SELECT DISTINCT site, a.var AS src, s.nature, b.var AS dst FROM call_site c JOIN summary_link s ON s.m = c.callee JOIN call_arg a USING (site) JOIN call_arg b USING (site) WHERE a.pos = s.from_pos AND b.pos = s.to_pos")
def call_summaries(f: Facts) -> DataFrame:
    """Callee summaries applied to the arguments at each call."""
    return links.apply_summaries(f.call_site.select("site", "callee"), f.call_arg, f.summary_link)


@query("SELECT DISTINCT a.site, a.pos, a.var AS from_var, b.var AS to_var FROM call_arg a JOIN call_arg b USING (site) WHERE a.pos < b.pos")
def argument_pairs(f: Facts) -> DataFrame:
    """Pairs of arguments of one call."""
    b = f.call_arg.select("site", F.col("pos").alias("to_pos"), F.col("var").alias("to_var"))
    return f.call_arg.join(b, "site").where("pos < to_pos").select("site", "pos", F.col("var").alias("from_var"), "to_var").distinct()


@query("SELECT DISTINCT e.src, m.m AS callee FROM call_edge e JOIN override_edge o ON o.sup = e.dst JOIN method m ON m.m = o.sub JOIN method d ON d.m = e.src WHERE m.owner % 5 = d.owner % 5")
def cone_implementations(f: Facts) -> DataFrame:
    """Implementations of a called method inside the receiver's type cone."""
    m = f.method.select(F.col("m").alias("callee"), F.col("owner").alias("o1"))
    d = f.method.select(F.col("m").alias("src"), F.col("owner").alias("o2"))
    calls = f.call_edge.join(f.override_edge, F.col("dst") == F.col("sup")).select("src", F.col("sub").alias("callee"))
    return calls.join(m, "callee").join(d, "src").where("o1 % 5 = o2 % 5").select("src", "callee").distinct()


@query("SELECT container, target FROM slice GROUP BY 1, 2 HAVING count(DISTINCT slice) = 3")
def division_slice_complete(f: Facts) -> DataFrame:
    """Containers whose slices all link to one target."""
    return links.complete_slices(f.slice, 3)


@query("""
WITH a AS (SELECT slice AS alt, container AS var, min(target) AS grp, container % 3 = 0 AS is_source FROM slice GROUP BY 1, 2), n AS (SELECT count(DISTINCT alt) AS n FROM a)
SELECT var, min(grp) AS grp FROM a, n GROUP BY var, n HAVING count(DISTINCT grp) = 1 AND (count(DISTINCT alt) = n OR bool_and(is_source))
""")
def group_join(f: Facts) -> DataFrame:
    """Which members stay in their group where alternatives meet."""
    return links.join_groups(f.slice.groupBy(F.col("slice").alias("alt"), F.col("container").alias("var")).agg(F.min("target").alias("grp")).withColumn("is_source", F.col("var") % 3 == 0))


@query("""
WITH p AS (SELECT m, list_sort(list(DISTINCT nature)) AS pass FROM summary_link GROUP BY 1)
SELECT o.sub, o.sup, list_sort([x FOR x IN a.pass IF list_contains(b.pass, x)]) AS pass FROM override_edge o JOIN p a ON a.m = o.sub JOIN p b ON b.m = o.sup
""")
def pass_set_intersection(f: Facts) -> DataFrame:
    """The pass set two identities share, in order."""
    p = f.summary_link.groupBy("m").agg(F.array_sort(F.collect_set("nature")).alias("pass"))
    a, b = p.select(F.col("m").alias("sub"), F.col("pass").alias("a")), p.select(F.col("m").alias("sup"), F.col("pass").alias("b"))
    return f.override_edge.join(a, "sub").join(b, "sup").select("sub", "sup", F.array_sort(F.array_intersect("a", "b")).alias("pass"))


@query("SELECT src, nature, dst FROM base_link UNION SELECT m * 8 + from_pos, nature, m * 8 + to_pos FROM summary_link")
def link_union(f: Facts) -> DataFrame:
    """The union of link sets."""
    summaries = f.summary_link.select((F.col("m") * 8 + F.col("from_pos")).alias("src"), "nature", (F.col("m") * 8 + F.col("to_pos")).alias("dst"))
    return f.base_link.unionByName(summaries).distinct()


@query("SELECT coalesce(a.sup, src) AS src, nature, coalesce(b.sup, dst) AS dst FROM base_link LEFT JOIN (SELECT sub, min(sup) AS sup FROM override_edge GROUP BY 1) a ON a.sub = src LEFT JOIN (SELECT sub, min(sup) AS sup FROM override_edge GROUP BY 1) b ON b.sub = dst")
def link_translation(f: Facts) -> DataFrame:
    """Links with their variables renamed."""
    return links.translate(f.base_link, f.override_edge.groupBy(F.col("sub").alias("from_var")).agg(F.min("sup").alias("to_var")))


@query("WITH RECURSIVE a(var, anc, depth) AS (SELECT t, t, 0 FROM typ UNION ALL SELECT a.var, typ.parent, depth + 1 FROM a JOIN typ ON typ.t = a.anc WHERE typ.parent IS NOT NULL) SELECT var, anc, depth FROM a")
def scope_closure(f: Facts) -> DataFrame:
    """All scopes of each variable with their distance."""
    return links.ancestors(f.typ.select(F.col("t").alias("var"), "parent"))


@query("""
SELECT a.idx AS a, b.idx AS b, b.idx = a.scope OR starts_with(b.idx, a.scope || '.') AS in_scope, regexp_replace(a.idx, '(^|\\.)[^.]*$', '') = regexp_replace(b.idx, '(^|\\.)[^.]*$', '') AS same,
  a.idx < b.idx AND starts_with(b.idx, regexp_replace(a.idx, '(^|\\.)[^.]*$', '') || '.') AS seen FROM stmt a JOIN stmt b ON a.scope = b.scope
""")
def statement_scopes(f: Facts) -> DataFrame:
    """Scope, level and visibility of statement indices."""
    s = f.stmt.withColumnRenamed("idx", "a")
    t = s.select(F.col("a").alias("b"), F.col("scope").alias("other"))
    a, b = F.col("a"), F.col("b")
    return s.join(t, F.col("scope") == F.col("other")).select("a", "b", scalars.in_scope_of(F.col("scope"), b).alias("in_scope"), scalars.same_level(a, b).alias("same"), scalars.seen_by(a, b).alias("seen"))


@query("""
SELECT m, CASE WHEN max(CASE WHEN nature % 3 = 0 THEN 1 WHEN nature % 3 = 1 THEN 0 END) = 1 THEN 0 WHEN count(*) FILTER (nature % 3 = 2) > 0 THEN NULL WHEN max(CASE WHEN to_pos > 5 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 2 END AS independent FROM summary_link GROUP BY 1
""")
def worst_links(f: Facts) -> DataFrame:
    """Independence by the worst link."""
    mutable = F.when(F.col("nature") % 3 == 0, F.lit(True)).when(F.col("nature") % 3 == 1, F.lit(False))
    return f.summary_link.groupBy("m").agg(lattice.worst_link(mutable, F.col("to_pos") > 5).alias("independent"))


@query("SELECT m, bool_or(to_pos = 1 AND nature >= 16) AND bool_and(to_pos = 1) AS identity, bool_or(to_pos = 2) AND bool_and(to_pos = 2) AS fluent FROM summary_link GROUP BY 1")
def identity_fluent(f: Facts) -> DataFrame:
    """Methods that return their first parameter, or themselves."""
    to = F.col("to_pos")
    return f.summary_link.groupBy("m").agg((F.max((to == 1) & (F.col("nature") >= 16)) & F.min(to == 1)).alias("identity"), (F.max(to == 2) & F.min(to == 2)).alias("fluent"))


@query("""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM base_link WHERE nature >= 17 UNION SELECT dst, src FROM base_link WHERE nature >= 17),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node, min(b) AS root FROM r GROUP BY a HAVING min(b) <> a
""")
def assignment_groups(f: Facts) -> DataFrame:
    """Variables joined by assignments, named by their least."""
    return components.roots(f.base_link.where("nature >= 17").select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
