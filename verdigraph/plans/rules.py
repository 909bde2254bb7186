"""Rules over extractor facts: variables and links, passed functions, null sources and policies, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import algebra
from verdigraph.operators import fixpoint, lattice, links, verdict_rules
from verdigraph.plans.linking import _ALGEBRA
from verdigraph.plans.registry import Facts, query

_R = algebra.RANK


@query("SELECT var, kind = 'virtual' OR kind = 'virtual_mod' AS is_virtual, kind = 'virtual_mod' AS is_modification FROM variable")
def virtual_variables(f: Facts) -> DataFrame:
    """P5: virtual fields, and those of them that stand for a modification."""
    return f.variable.select("var", F.col("kind").isin("virtual", "virtual_mod").alias("is_virtual"), (F.col("kind") == "virtual_mod").alias("is_modification"))


@query("SELECT DISTINCT b.src, b.nature, b.dst FROM base_link b JOIN variable x ON x.var = b.src JOIN variable y ON y.var = b.dst WHERE x.kind <> 'local' AND y.kind <> 'local'")
def summary_visible(f: Facts) -> DataFrame:
    """Links that a method's summary may show: neither end is a local."""
    seen = f.variable.where("kind <> 'local'").select("var")
    return f.base_link.join(seen.select(F.col("var").alias("src")), "src", "left_semi").join(seen.select(F.col("var").alias("dst")), "dst", "left_semi").select("src", "nature", "dst")


@query("SELECT DISTINCT b.src, b.nature, b.dst FROM base_link b WHERE b.src NOT IN (SELECT var FROM variable WHERE kind LIKE 'virtual%') AND b.dst NOT IN (SELECT var FROM variable WHERE kind LIKE 'virtual%')")
def node_links(f: Facts) -> DataFrame:
    """Links between nodes of the graph; hidden-content fields are none."""
    hidden = f.variable.where("kind in ('virtual', 'virtual_mod')").select("var")
    return f.base_link.join(hidden, F.col("src") == F.col("var"), "left_anti").join(hidden, F.col("dst") == F.col("var"), "left_anti")


@query("SELECT DISTINCT v.var, a.arg AS concrete FROM variable v JOIN method m ON m.m = v.m JOIN type_arg a ON a.t = m.owner WHERE v.kind = 'virtual'")
def virtual_translation(f: Facts) -> DataFrame:
    """A formal virtual field becomes that of the owner's type argument."""
    formal = f.variable.where("kind = 'virtual'").select("var", "m")
    return formal.join(f.method.select("m", "owner"), "m").join(f.type_arg, F.col("owner") == F.col("t")).select("var", F.col("arg").alias("concrete")).distinct()


@query("SELECT DISTINCT coalesce(-1 - a.value, b.src) AS src, b.nature, coalesce(-1 - c.value, b.dst) AS dst FROM base_link b LEFT JOIN constant a ON a.var = b.src LEFT JOIN constant c ON c.var = b.dst")
def constant_replacement(f: Facts) -> DataFrame:
    """Variables that are assigned one constant are replaced by it (below zero, as -1 - value)."""
    named = f.constant.select(F.col("var").alias("from_var"), (-1 - F.col("value")).alias("to_var"))
    return links.translate(f.base_link, named).distinct()


@query("SELECT b.src, b.nature, b.dst, c.a IS NOT NULL AS mediated FROM base_link b LEFT JOIN (SELECT a, b FROM cast_site UNION SELECT b, a FROM cast_site) c ON c.a = b.src AND c.b = b.dst")
def mediated_links(f: Facts) -> DataFrame:
    """Links that a cast or a pattern mediates, either way round."""
    casts = f.cast_site.union(f.cast_site.select("b", "a")).distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("mediated"))
    return f.base_link.join(casts, ["src", "dst"], "left").select("src", "nature", "dst", F.coalesce("mediated", F.lit(False)).alias("mediated"))


@query(f"""
WITH RECURSIVE d(src, dst) AS (SELECT src, dst FROM base_link WHERE nature = {_R["∈"]} UNION SELECT d.src, b.dst FROM d JOIN base_link b ON b.src = d.dst AND b.nature = {_R["→"]} WHERE d.src <> b.dst) SELECT src, dst FROM d
""")
def direct_links(f: Facts) -> DataFrame:
    """Direct element links, carried along assignments, but not by way of the owner itself."""
    start = f.base_link.where(F.col("nature") == _R["∈"]).select(F.col("src").alias("owner"), F.col("dst").alias("node"))
    along = f.base_link.where(F.col("nature") == _R["→"]).select("src", "dst")
    return fixpoint.pairs(along, start, through_owner=False).select(F.col("owner").alias("src"), F.col("node").alias("dst")).distinct()


_GETSET = """g AS (SELECT m, min(f) AS f, false AS is_setter FROM reads WHERE m NOT IN (SELECT m FROM assignment) GROUP BY m HAVING count(*) = 1
  UNION ALL SELECT m, min(f), true FROM assignment WHERE m NOT IN (SELECT m FROM reads) GROUP BY m HAVING count(*) = 1)"""


def _get_set(f: Facts) -> DataFrame:
    one = lambda own, other, setter: own.join(other.select("m"), "m", "left_anti").groupBy("m").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n")).where("n = 1").select("m", "f", F.lit(setter).alias("is_setter"))
    return one(f.reads, f.assignment, False).unionByName(one(f.assignment, f.reads, True))


@query(f"WITH {_GETSET} SELECT m, f, is_setter FROM g")
def getters_setters(f: Facts) -> DataFrame:
    """P20: a getter reads one field and assigns none, a setter assigns one and reads none."""
    return _get_set(f)


@query(f"WITH {_GETSET} SELECT c.site, c.callee, g.f, g.is_setter FROM call_site c JOIN g ON g.m = c.callee")
def getset_substitution(f: Facts) -> DataFrame:
    """Calls of getters and setters, as accesses of their field."""
    return f.call_site.join(_get_set(f), F.col("callee") == F.col("m")).select("site", "callee", "f", "is_setter")


@query(f"WITH {_GETSET} SELECT m, CASE WHEN g.m IS NOT NULL THEN NOT g.is_setter WHEN m IN (SELECT m FROM reads) OR m IN (SELECT m FROM assignment) THEN non_modifying ELSE true END AS non_modifying FROM method LEFT JOIN g USING (m)")
def shortcut_verdicts(f: Facts) -> DataFrame:
    """V9: getters and empty methods modify nothing, setters do; the others keep their verdict."""
    busy = f.reads.select("m").union(f.assignment.select("m")).distinct().withColumn("busy", F.lit(True))
    x = f.method.select("m", "non_modifying").join(_get_set(f), "m", "left").join(busy, "m", "left")
    return x.select("m", F.when(F.col("is_setter").isNotNull(), ~F.col("is_setter")).when(F.col("busy"), F.col("non_modifying")).otherwise(True).alias("non_modifying"))


@query(f"""
WITH {_ALGEBRA} SELECT DISTINCT l.site, a.var AS src, k.t AS nature, l.fn AS dst FROM lambda_binding l JOIN call_site c USING (site) JOIN summary_link s ON s.m = c.callee AND s.to_pos = l.pos
JOIN call_arg a ON a.site = l.site AND a.pos = s.from_pos JOIN summary_link b ON b.m = l.fn AND b.from_pos = 1 JOIN combine k ON k.r = s.nature AND k.s = b.nature
""")
def functional_lift(f: Facts) -> DataFrame:
    """What a callee hands to a passed function, lifted through the function's own summary.

    The callee's link from an argument to the function's position composes with the function's links
    from its first parameter; labels weaken as the algebra says, and vanish where nothing composes.
    """
    at = f.lambda_binding.join(f.call_site.select("site", "callee"), "site")
    handed = at.join(f.summary_link.select(F.col("m").alias("callee"), "from_pos", F.col("nature").alias("r"), F.col("to_pos").alias("pos")), ["callee", "pos"])
    named = handed.join(f.call_arg.select("site", F.col("pos").alias("from_pos"), "var"), ["site", "from_pos"])
    inner = f.summary_link.where("from_pos = 1").select(F.col("m").alias("fn"), F.col("nature").alias("s"))
    return named.join(inner, "fn").select("site", F.col("var").alias("src"), F.col("fn").alias("dst"), "r", "s").distinct().join(F.broadcast(algebra.table(f.spark)), ["r", "s"]).select("site", "src", F.col("t").alias("nature"), "dst").distinct()


@query("""
WITH RECURSIVE b(site, fn) AS (SELECT DISTINCT site, fn FROM lambda_binding UNION SELECT c.site, b.fn FROM b JOIN call_site o ON o.site = b.site JOIN call_site c ON c.callee = o.caller) SELECT site, fn FROM b
""")
def applied_functions(f: Facts) -> DataFrame:
    """Functions that a call passes on are known at the calls of its method as well, and so on."""
    outer = f.call_site.select(F.col("site").alias("src"), F.col("caller").alias("callee")).join(f.call_site.select(F.col("site").alias("dst"), "callee"), "callee")
    start = f.lambda_binding.select(F.col("fn").alias("owner"), F.col("site").alias("node"))
    return fixpoint.pairs(outer, start).select(F.col("node").alias("site"), F.col("owner").alias("fn")).distinct()


@query("SELECT DISTINCT a.site, a.pos FROM call_arg a JOIN call_site c USING (site) JOIN summary_link s ON s.m = c.callee AND s.to_pos = a.pos WHERE NOT EXISTS (SELECT 1 FROM lambda_binding l WHERE l.site = a.site AND l.pos = a.pos)")
def opaque_consumers(f: Facts) -> DataFrame:
    """Arguments that receive something and are bound to no known function."""
    receives = f.call_site.select("site", "callee").join(f.summary_link.select(F.col("m").alias("callee"), F.col("to_pos").alias("pos")).distinct(), "callee")
    return f.call_arg.select("site", "pos").join(receives, ["site", "pos"], "left_semi").join(f.lambda_binding, ["site", "pos"], "left_anti").distinct()


@query("SELECT DISTINCT a.site, a.pos, CASE WHEN l.fn IS NULL THEN 'opaque' WHEN m.non_modifying THEN 'none' WHEN m.non_modifying IS NULL THEN 'undecided' ELSE 'modifies' END AS effect FROM call_arg a LEFT JOIN lambda_binding l USING (site, pos) LEFT JOIN method m ON m.m = l.fn")
def passed_function_effect(f: Facts) -> DataFrame:
    """What a passed function does to what it gets."""
    x = f.call_arg.select("site", "pos").distinct().join(f.lambda_binding, ["site", "pos"], "left").join(f.method.select(F.col("m").alias("fn"), "non_modifying"), "fn", "left")
    effect = F.when(F.col("fn").isNull(), "opaque").when(F.col("non_modifying"), "none").when(F.col("non_modifying").isNull(), "undecided").otherwise("modifies")
    return x.select("site", "pos", effect.alias("effect"))


@query(f"SELECT m, pos, arrays, arrays_source, reverse, CASE WHEN arrays = arrays_source AND arrays > 0 THEN {_R['⊆']} WHEN arrays = arrays_source AND reverse THEN {_R['→']} WHEN arrays = arrays_source THEN {_R['←']} WHEN arrays < arrays_source THEN {_R['∈']} ELSE {_R['∋']} END AS nature FROM dims")
def shallow_links(f: Facts) -> DataFrame:
    """Links of members without a body, by array dimensions."""
    return f.dims.withColumn("nature", verdict_rules.shallow_nature(F.col("arrays"), F.col("arrays_source"), F.col("reverse")))


@query("""
WITH RECURSIVE r(t, arg) AS (SELECT t, t FROM typ UNION SELECT r.t, a.arg FROM r JOIN type_arg a ON a.t = r.arg) SELECT r.t, min(y.hint) AS level FROM r JOIN typ y ON y.t = r.arg GROUP BY 1
""")
def parameterised_immutability(f: Facts) -> DataFrame:
    """A type is as immutable as the least of itself and its type arguments, at any depth."""
    own = f.typ.select(F.col("t").alias("owner"), F.col("t").alias("node"))
    every = fixpoint.pairs(f.type_arg.select(F.col("t").alias("src"), F.col("arg").alias("dst")), own)
    return every.join(f.typ.select(F.col("t").alias("node"), "hint"), "node").groupBy(F.col("owner").alias("t")).agg(F.min("hint").alias("level"))


@query("SELECT t, CASE WHEN bool_or(NOT is_final) THEN 0 WHEN bool_or(unmodified IS NULL) THEN NULL WHEN bool_or(NOT unmodified) THEN 1 ELSE coalesce(min(immutable), 3) END AS level FROM typ LEFT JOIN (SELECT * FROM field WHERE f NOT IN (SELECT f FROM ignored)) x ON x.owner = t GROUP BY 1")
def immutable_after_mark(f: Facts) -> DataFrame:
    """V6: immutability when the fields that carry the mark are excused; undecided fields wait."""
    kept = f.field.join(f.ignored, "f", "left_anti")
    x = f.typ.select("t").join(kept, F.col("t") == F.col("owner"), "left").groupBy("t")
    y = x.agg(F.max(~F.col("is_final")).alias("open"), F.max(F.col("f").isNotNull() & F.col("unmodified").isNull()).alias("waits"), F.max(~F.col("unmodified")).alias("changed"), F.min("immutable").alias("least"))
    return y.select("t", F.when(F.col("open"), 0).when(F.col("waits"), F.lit(None)).when(F.col("changed"), 1).otherwise(F.coalesce("least", F.lit(3))).alias("level"))


@query(f"SELECT m, list_sort(list(DISTINCT to_pos)) AS passes FROM summary_link WHERE nature = {_R['≡']} GROUP BY 1")
def dependent_exceptions(f: Facts) -> DataFrame:
    """V8: the parameters that a method's dependence excepts: those it is identical to."""
    return f.summary_link.where(F.col("nature") == _R["≡"]).groupBy("m").agg(F.array_sort(F.collect_set("to_pos")).alias("passes"))


@query("SELECT f, CASE WHEN bool_and(s.m IS NOT NULL) THEN list_sort(list(DISTINCT s.nature)) END AS natures FROM reads r LEFT JOIN summary_link s USING (m) GROUP BY 1")
def field_links(f: Facts) -> DataFrame:
    """A field's links are those of all methods that refer to it; none until all have some."""
    x = f.reads.join(f.summary_link.select("m", "nature").distinct(), "m", "left")
    return x.groupBy("f").agg(F.min(F.col("nature").isNotNull()).alias("all"), F.array_sort(F.collect_set("nature")).alias("natures")).select("f", F.when(F.col("all"), F.col("natures")).alias("natures"))


@query(f"SELECT DISTINCT src, CASE WHEN nature IN ({_R['⊆']}, {_R['⊇']}) AND (src IN (SELECT var FROM modified_var) OR dst IN (SELECT var FROM modified_var)) THEN {_R['~']} ELSE nature END AS nature, dst FROM base_link")
def relabel_modified(f: Facts) -> DataFrame:
    """Inclusions at a modified end weaken to sharing."""
    hit = lambda end: f.modified_var.select(F.col("var").alias(end), F.lit(True).alias(end + "_hit"))
    x = f.base_link.join(hit("src"), "src", "left").join(hit("dst"), "dst", "left")
    weak = F.col("nature").isin(_R["⊆"], _R["⊇"]) & (F.col("src_hit").isNotNull() | F.col("dst_hit").isNotNull())
    return x.select("src", F.when(weak, _R["~"]).otherwise(F.col("nature")).alias("nature"), "dst").distinct()


@query(f"""
WITH {_ALGEBRA}, gone AS (SELECT var FROM variable WHERE kind = 'local'), made AS (SELECT DISTINCT x.src, k.t AS nature, y.dst FROM base_link x JOIN base_link y ON y.src = x.dst JOIN combine k ON k.r = x.nature AND k.s = y.nature WHERE x.dst IN (SELECT var FROM gone) AND x.src <> y.dst)
SELECT src, nature, dst FROM (SELECT src, nature, dst FROM base_link UNION SELECT src, nature, dst FROM made) WHERE src NOT IN (SELECT var FROM gone) AND dst NOT IN (SELECT var FROM gone)
""")
def scope_exit(f: Facts) -> DataFrame:
    """Locals leave; what they linked is composed through them first."""
    gone = f.variable.where("kind = 'local'").select("var")
    return links.remove_vertices(f.base_link, gone, algebra.table(f.spark))


@query("SELECT c.site, list_sort(list(DISTINCT b.dst)) AS linked FROM call_site c JOIN call_arg a ON a.site = c.site AND a.pos = 1 JOIN base_link b ON b.src = a.var * 8 + 4 GROUP BY 1")
def linked_to_object(f: Facts) -> DataFrame:
    """The variables linked to the object of each call."""
    of = f.call_arg.where("pos = 1").select("site", (F.col("var") * 8 + 4).alias("src"))
    return f.call_site.select("site").join(of, "site").join(f.base_link, "src").groupBy("site").agg(F.array_sort(F.collect_set("dst")).alias("linked"))


@query()
def always_escapes(f: Facts) -> DataFrame:
    """How each statement goes on: falls through, breaks out, or always escapes. No SQL: an ordered bottom-up fold; tests hold it against a recursive version."""
    return verdict_rules.flow(f.statement).withColumn("always_escapes", ~F.col("falls_through") & ~F.col("breaks_out"))


@query("SELECT node, bool_or(source IN ('literal', 'argument')) AS strict FROM null_source GROUP BY 1")
def null_seeds(f: Facts) -> DataFrame:
    """Null seeds; strict where somebody wrote the null."""
    return verdict_rules.counted_sources(f.null_source, verdict_rules.NULL_MARKED)


@query("SELECT var, size - filled AS holes FROM array_init WHERE filled < size")
def array_holes(f: Facts) -> DataFrame:
    """Arrays created with nulls that no loop fills."""
    return f.array_init.where("filled < size").select("var", (F.col("size") - F.col("filled")).alias("holes"))


@query("SELECT t AS src, arg AS dst FROM type_arg UNION SELECT arg, t FROM type_arg WHERE invariant")
def content_coupling(f: Facts) -> DataFrame:
    """Null content flows to the type argument, and back where it is invariant."""
    both = f.type_arg.where("invariant").select(F.col("arg").alias("src"), F.col("t").alias("dst"))
    return f.type_arg.select(F.col("t").alias("src"), F.col("arg").alias("dst")).union(both).distinct()


@query("SELECT DISTINCT c.site, CASE l.returns WHEN 'nullable' THEN -1 WHEN 'view of argument' THEN a.var END AS source FROM call_site c JOIN library l ON l.m = c.callee LEFT JOIN call_arg a ON a.site = c.site AND a.pos = 1 WHERE l.returns = 'nullable' OR l.returns = 'view of argument' AND a.var IS NOT NULL")
def library_results(f: Facts) -> DataFrame:
    """Where a library call's result gets null from: the contract (-1) or its first argument."""
    at = f.call_site.select("site", F.col("callee").alias("m")).join(f.library, "m").join(f.call_arg.where("pos = 1").select("site", "var"), "site", "left")
    source = F.when(F.col("returns") == "nullable", F.lit(-1).cast("long")).when(F.col("returns") == "view of argument", F.col("var"))
    return at.select("site", source.alias("source")).where("source is not null").distinct()


@query("""
WITH RECURSIVE u(m, anc, d) AS (SELECT m, m, 0 FROM method UNION SELECT u.m, o.sup, u.d + 1 FROM u JOIN override_edge o ON o.sub = u.anc), n AS (SELECT u.m, l.returns, min(u.d) AS d FROM u JOIN library l ON l.m = u.anc GROUP BY 1, 2)
SELECT m, min(returns) AS returns FROM n JOIN (SELECT m, min(d) AS d FROM n GROUP BY 1) USING (m, d) GROUP BY 1
""")
def library_contracts(f: Facts) -> DataFrame:
    """The contract of the nearest declaration that a library has; of equals the first by name."""
    return links.nearest_above(f.method.select("m"), f.override_edge, f.library.select(F.col("m").alias("anc"), F.col("returns").alias("value"))).select("m", F.col("value").alias("returns"))


@query("SELECT DISTINCT e.src, e.dst FROM call_edge e JOIN method a ON a.m = e.src JOIN method b ON b.m = e.dst WHERE NOT b.immutable_type AND NOT (e.src NOT IN (SELECT m FROM production) AND e.dst IN (SELECT m FROM production))")
def null_edges_cut(f: Facts) -> DataFrame:
    """No null flows into a primitive (immutable leaf), nor from test code into production code."""
    leaf = f.method.where("immutable_type").select(F.col("m").alias("dst"))
    prod = lambda end: f.production.select(F.col("m").alias(end), F.lit(True).alias(end + "_prod"))
    known = lambda end: f.method.select(F.col("m").alias(end))
    x = f.call_edge.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").join(leaf, "dst", "left_anti").join(prod("src"), "src", "left").join(prod("dst"), "dst", "left")
    return x.where(~(F.col("src_prod").isNull() & F.col("dst_prod").isNotNull())).select("src", "dst").distinct()


_REACHED = """r(node) AS (SELECT node FROM null_source WHERE node NOT IN (SELECT m FROM contract) UNION SELECT e.dst FROM r JOIN call_edge e ON e.src = r.node WHERE e.dst NOT IN (SELECT m FROM contract))"""


@query(f"WITH RECURSIVE {_REACHED} SELECT DISTINCT c.site, p.pos, a.var FROM precondition p JOIN call_site c ON c.callee = p.m JOIN call_arg a ON a.site = c.site AND a.pos = p.pos WHERE a.var IN (SELECT node FROM r)")
def null_precondition_arguments(f: Facts) -> DataFrame:
    """Arguments that may be null where the callee demands that they are not."""
    reached = fixpoint.null_reach(f.call_edge, f.null_source.select("node"), f.contract.select(F.col("m").alias("node"))).select(F.col("node").alias("var"))
    demanded = f.precondition.join(f.call_site.select("site", F.col("callee").alias("m")), "m").select("site", "pos")
    return f.call_arg.join(demanded, ["site", "pos"], "left_semi").join(reached, "var", "left_semi").select("site", "pos", "var").distinct()


@query("SELECT DISTINCT c.site FROM call_site c JOIN library l ON l.m = c.callee WHERE l.is_value_of")
def enum_value_of(f: Facts) -> DataFrame:
    """Calls of an enum's valueOf, whose result is never null."""
    return f.call_site.join(f.library.where("is_value_of").select(F.col("m").alias("callee")), "callee", "left_semi").select("site").distinct()


_STATES = " UNION ALL ".join(
    f"SELECT '{p.name}' AS policy, m, CASE WHEN m IN (SELECT m FROM contract) THEN 'NONNULL' WHEN m IN (SELECT node FROM {'flow' if not p.null_tests else 'r'}) THEN 'NULLABLE' ELSE '{p.unreached}' END AS state FROM method" for p in verdict_rules.PRESETS
)


@query(f"WITH RECURSIVE {_REACHED}, {_REACHED.replace('r(node)', 'flow(node)').replace('FROM null_source WHERE', 'FROM null_source WHERE source <> ' + chr(39) + 'null test' + chr(39) + ' AND').replace('FROM r JOIN', 'FROM flow JOIN').replace('e.src = r.node', 'e.src = flow.node')} {_STATES}")
def null_policies(f: Facts) -> DataFrame:
    """Every declaration's state under each preset."""
    bound, out = f.contract.select("m", F.lit(True).alias("bound")).distinct(), []
    for policy in verdict_rules.PRESETS:
        seeds = verdict_rules.counted_sources(f.null_source, policy).select("node")
        reached = fixpoint.null_reach(f.call_edge, seeds, bound.select(F.col("m").alias("node"))).select(F.col("node").alias("m"), F.lit(True).alias("hit"))
        x = f.method.select("m").join(reached, "m", "left").join(bound, "m", "left")
        out.append(x.select(F.lit(policy.name).alias("policy"), "m", verdict_rules.state(F.col("hit").isNotNull(), F.col("bound").isNotNull(), policy).alias("state")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT f.owner AS t, f.f FROM field f JOIN (SELECT DISTINCT owner FROM method JOIN contract USING (m)) c ON c.owner = f.owner WHERE NOT f.unmodified AND NOT f.is_private")
def guard_independent(f: Facts) -> DataFrame:
    """C4: exposed fields that a modification from outside can reach, in types that promise independence."""
    bound = f.method.join(f.contract, "m").select("owner").distinct()
    return f.field.where("not unmodified and not is_private").join(bound, "owner", "left_semi").select(F.col("owner").alias("t"), "f")


@query("SELECT f, min(CASE WHEN m.immutable_type THEN 3 ELSE f.immutable END) AS proven FROM field f JOIN assignment a USING (f) JOIN method m ON m.m = a.m GROUP BY 1")
def guard_dynamic_immutable(f: Facts) -> DataFrame:
    """What a field holds is as immutable as the least of the values assigned to it."""
    level = F.when(F.col("immutable_type"), 3).otherwise(F.col("immutable"))
    return f.assignment.join(f.field, "f").join(f.method.select("m", "immutable_type"), "m").groupBy("f").agg(F.min(level).alias("proven"))


@query("""
WITH RECURSIVE r(f, m) AS (SELECT f, m FROM assignment WHERE f IN (SELECT f FROM ignored) UNION SELECT r.f, o.sup FROM r JOIN override_edge o ON o.sub = r.m)
SELECT DISTINCT r.f, r.m FROM r JOIN reads d ON d.m = r.m WHERE d.f NOT IN (SELECT f FROM ignored)
""")
def guard_ignored_modifications(f: Facts) -> DataFrame:
    """Methods by which what may be modified freely meets fields that may not be."""
    start = f.assignment.join(f.ignored, "f", "left_semi").select(F.col("f").alias("owner"), F.col("m").alias("node"))
    carried = fixpoint.pairs(f.override_edge.select(F.col("sub").alias("src"), F.col("sup").alias("dst")), start)
    other = f.reads.join(f.ignored, "f", "left_anti").select(F.col("m").alias("node")).distinct()
    return carried.join(other, "node", "left_semi").select(F.col("owner").alias("f"), F.col("node").alias("m")).distinct()


@query("SELECT DISTINCT r.m AS src, x.f AS dst FROM reads r JOIN field f ON f.f = r.f JOIN field x ON x.owner = f.owner WHERE x.f = r.f OR NOT x.is_final")
def mod_field_reference_edges(f: Facts) -> DataFrame:
    """M5: a reference leads to the field and to the fields of its owner that can be assigned."""
    a = f.reads.join(f.field.select("f", "owner"), "f").select("m", F.col("f").alias("own"), "owner")
    x = f.field.select(F.col("f").alias("dst"), "owner", "is_final")
    return a.join(x, "owner").where("own = dst or not is_final").select(F.col("m").alias("src"), "dst").distinct()


@query("SELECT DISTINCT c.caller AS node FROM call_site c JOIN method m ON m.m = c.callee WHERE NOT m.non_modifying AND c.callee NOT IN (SELECT src FROM call_edge)")
def mod_boundary_seeds(f: Facts) -> DataFrame:
    """Callers of a modifying method that is outside the analysed graph."""
    outside = f.method.where("not non_modifying").select(F.col("m").alias("callee")).join(f.call_edge.select(F.col("src").alias("callee")), "callee", "left_anti")
    return f.call_site.join(outside, "callee", "left_semi").select(F.col("caller").alias("node")).distinct()


@query("SELECT DISTINCT v.m AS node, v.var FROM variable v JOIN modified_var USING (var) WHERE v.kind = 'field'")
def mod_statement_field_seeds(f: Facts) -> DataFrame:
    """Fields that a method's last statement leaves modified."""
    return f.variable.where("kind = 'field'").join(f.modified_var, "var", "left_semi").select(F.col("m").alias("node"), "var").distinct()


@query("SELECT CASE WHEN m.is_abstract THEN 'abstract' ELSE 'concrete' END AS kind, m.independent AS depth, CASE WHEN m.non_modifying IS NULL THEN 'undecided' WHEN m.non_modifying = (c.m IS NULL) THEN 'agree' ELSE 'differ' END AS outcome, count(*) AS n FROM method m LEFT JOIN (SELECT DISTINCT m FROM contract) c USING (m) GROUP BY 1, 2, 3")
def confusion_by_kind(f: Facts) -> DataFrame:
    """Verdicts against declared contracts, by kind and depth."""
    x = f.method.join(f.contract.select("m", F.lit(True).alias("bound")).distinct(), "m", "left")
    outcome = F.when(F.col("non_modifying").isNull(), "undecided").when(F.col("non_modifying") == F.col("bound").isNull(), "agree").otherwise("differ")
    return x.groupBy(F.when(F.col("is_abstract"), "abstract").otherwise("concrete").alias("kind"), F.col("independent").alias("depth"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
