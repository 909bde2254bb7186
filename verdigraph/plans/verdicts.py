"""Folds, lattice rules, contracts, guard findings, nullness, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import scalars
from verdigraph.operators import fixpoint, lattice, links
from verdigraph.plans.registry import Facts, query


@query("SELECT sup AS m, min(CASE WHEN non_modifying THEN 1 ELSE 0 END) = 1 AS non_modifying FROM override_edge JOIN method ON m = sub WHERE sup NOT IN (SELECT m FROM contract) GROUP BY 1")
def abstract_fold_nonmodifying(f: Facts) -> DataFrame:
    """TRUE iff every implementation is; undecided counts as FALSE; contracts skip the fold."""
    impl = f.override_edge.join(f.method, F.col("sub") == F.col("m")).select(F.col("sup").alias("m"), "non_modifying")
    return impl.join(f.contract.select("m"), "m", "left_anti").groupBy("m").agg(lattice.all_or_false(F.col("non_modifying")).alias("non_modifying"))


@query("SELECT sup AS m, CASE WHEN bool_or(non_modifying IS NULL) THEN NULL ELSE min(independent) END AS independent FROM override_edge JOIN method ON m = sub GROUP BY 1")
def abstract_fold_independent(f: Facts) -> DataFrame:
    """The least independence, or NULL while an implementation is undecided."""
    impl = f.override_edge.join(f.method, F.col("sub") == F.col("m")).select("sup", F.when(F.col("non_modifying").isNotNull(), F.col("independent")).alias("v"))
    return impl.groupBy(F.col("sup").alias("m")).agg(lattice.least_or_wait(F.col("v")).alias("independent"))


@query("SELECT t, coalesce(bool_and(coalesce(unmodified, false)), true) AS container FROM typ LEFT JOIN (SELECT owner, unmodified FROM method JOIN param USING (m) WHERE NOT is_private) x ON x.owner = t GROUP BY 1")
def container_type(f: Facts) -> DataFrame:
    """G1: no non-private method modifies a parameter; undecided counts as modified; TRUE without any."""
    p = f.method.where("not is_private").join(f.param, "m").groupBy(F.col("owner").alias("t")).agg(lattice.all_or_false(F.col("unmodified")).alias("container"))
    return f.typ.select("t").join(p, "t", "left").select("t", F.coalesce("container", F.lit(True)).alias("container"))


@query("SELECT m FROM method WHERE is_abstract AND m NOT IN (SELECT sup FROM override_edge)")
def without_implementations(f: Facts) -> DataFrame:
    """Abstract methods nothing implements."""
    return f.method.where("is_abstract").select("m").join(f.override_edge.select(F.col("sup").alias("m")), "m", "left_anti")


@query("SELECT sup AS m, CASE WHEN bool_or(non_modifying IS NULL) THEN NULL ELSE list_sort(list(DISTINCT owner)) END AS types FROM override_edge JOIN method ON m = sub GROUP BY 1")
def downcast_union(f: Facts) -> DataFrame:
    """The union of downcast types, waiting for undecided implementations."""
    impl = f.override_edge.join(f.method, F.col("sub") == F.col("m"))
    return impl.groupBy("sup").agg(F.when(~lattice.any_null(F.col("non_modifying")), F.array_sort(F.collect_set("owner"))).alias("types")).select(F.col("sup").alias("m"), "types")


@query("SELECT owner AS t, CASE WHEN bool_or(NOT unmodified) THEN false WHEN bool_or(unmodified IS NULL) THEN NULL ELSE true END AS unmodifiable FROM field GROUP BY 1")
def unmodifiable_type(f: Facts) -> DataFrame:
    """Three-valued conjunction over a type's fields."""
    return f.field.groupBy(F.col("owner").alias("t")).agg(lattice.all_or_wait(F.col("unmodified")).alias("unmodifiable"))


@query("SELECT t FROM typ WHERE t NOT IN (SELECT parent FROM typ WHERE parent IS NOT NULL)")
def never_extended(f: Facts) -> DataFrame:
    """Types nothing extends."""
    return f.typ.select("t").join(f.typ.where("parent is not null").select(F.col("parent").alias("t")), "t", "left_anti")


_RULES = """
WITH s AS (SELECT a.t, min(b.hint) AS least, bool_or(b.hint IS NULL) AS undecided FROM typ a JOIN typ b ON b.t = a.parent GROUP BY 1),
d AS (SELECT owner AS t, bool_or(NOT is_final AND NOT is_private AND f % 50 = 0) AS assignable, CASE WHEN bool_or(NOT unmodified AND f % 10 = 0) THEN false WHEN bool_or(unmodified IS NULL AND f % 10 = 1) THEN NULL ELSE true END AS rules FROM field GROUP BY 1),
i AS (SELECT owner AS t, CASE WHEN bool_or(non_modifying IS NULL AND m % 9 = 0) THEN NULL ELSE min(CASE WHEN m % 40 = 0 THEN independent ELSE 2 END) END AS indep FROM method GROUP BY 1),
x AS (SELECT t, coalesce(assignable, false) AS assignable, rules, indep, least, coalesce(undecided, false) AS sn, hint % 2 = 1 AS hc FROM typ LEFT JOIN s USING (t) LEFT JOIN d USING (t) LEFT JOIN i USING (t)),
v AS (SELECT t, CASE WHEN assignable THEN 0 WHEN least = 0 THEN 0 WHEN indep = 0 THEN CASE WHEN sn THEN NULL ELSE 1 END WHEN least = 1 THEN 1 WHEN NOT rules THEN 1 WHEN rules IS NULL THEN NULL WHEN sn OR indep IS NULL THEN NULL WHEN hc OR least = 2 OR indep = 1 THEN 2 ELSE 3 END AS immutable FROM x)"""


def _immutable(f: Facts) -> DataFrame:
    up = f.typ.select(F.col("t").alias("parent"), F.col("hint").alias("up"))
    s = f.typ.select("t", "parent").join(up, "parent").groupBy("t").agg(F.min("up").alias("least"), lattice.any_null(F.col("up")).alias("undecided"))
    ok = F.when(F.col("f") % 10 == 0, F.coalesce("unmodified", F.lit(True))).when(F.col("f") % 10 == 1, F.when(F.col("unmodified").isNotNull(), F.lit(True))).otherwise(F.lit(True))
    d = f.field.groupBy(F.col("owner").alias("t")).agg(F.max(~F.col("is_final") & ~F.col("is_private") & (F.col("f") % 50 == 0)).alias("assignable"), lattice.all_or_wait(ok).alias("rules"))
    content = F.when((F.col("m") % 9 == 0) & F.col("non_modifying").isNull(), None).when(F.col("m") % 40 == 0, F.col("independent")).otherwise(F.lit(2))
    i = f.method.groupBy(F.col("owner").alias("t")).agg(lattice.least_or_wait(content).alias("indep"))
    x = f.typ.join(s, "t", "left").join(d, "t", "left").join(i, "t", "left")
    level = lattice.immutability(F.coalesce("assignable", F.lit(False)), F.col("least"), F.coalesce("undecided", F.lit(False)), F.col("indep"), F.col("rules"), F.col("hint") % 2 == 1)
    return x.select("t", level.alias("immutable"))


@query(_RULES + " SELECT t, immutable FROM v")
def immutability_rules(f: Facts) -> DataFrame:
    """Immutability of types by ordered rules."""
    return _immutable(f)


@query(_RULES + " SELECT t, CASE immutable WHEN 3 THEN '@Immutable' WHEN 2 THEN '@Immutable(hc = true)' WHEN 1 THEN '@FinalFields' END AS annotation FROM v")
def decorate_types(f: Facts) -> DataFrame:
    """Verdicts as annotations."""
    return _immutable(f).select("t", scalars.annotation(F.col("immutable")).alias("annotation"))


@query("SELECT p, CASE WHEN immutable_type THEN true WHEN NOT a.unmodified THEN false WHEN NOT b.unmodified THEN false WHEN a.unmodified IS NULL OR b.f IS NULL OR b.unmodified IS NULL THEN NULL ELSE true END AS unmodified FROM param a JOIN method USING (m) LEFT JOIN field b ON b.f = a.linked_field")
def param_via_field(f: Facts) -> DataFrame:
    """V7: a parameter is unmodified if its type, the method and the field it goes to let it be."""
    x = f.param.join(f.method.select("m", "immutable_type"), "m").join(f.field.select(F.col("f").alias("linked_field"), F.col("unmodified").alias("of_field")), "linked_field", "left")
    own, other = F.col("unmodified"), F.col("of_field")
    value = F.when(F.col("immutable_type"), True).when(~own, False).when(~other, False).when(own.isNull() | other.isNull(), None).otherwise(True)
    return x.select("p", value.cast("boolean").alias("unmodified"))


@query("SELECT m, max(strength) AS strength, bool_or(own) AS own FROM (SELECT m, strength, true AS own FROM contract UNION ALL SELECT sub, strength, false FROM override_edge JOIN contract ON m = sup) GROUP BY 1")
def contract_resolution(f: Facts) -> DataFrame:
    """The strongest of a method's own and inherited contracts."""
    own = f.contract.select("m", "strength", F.lit(True).alias("own"))
    inherited = f.override_edge.join(f.contract, F.col("sup") == F.col("m")).select(F.col("sub").alias("m"), "strength", F.lit(False).alias("own"))
    return own.unionByName(inherited).groupBy("m").agg(F.max("strength").alias("strength"), F.max("own").alias("own"))


@query("SELECT m, coalesce(c.strength, i.strength, h.hint, 0)::BIGINT AS value, CASE WHEN c.strength IS NOT NULL THEN 'contract' WHEN i.strength IS NOT NULL THEN 'inherited' WHEN h.hint IS NOT NULL THEN 'type' ELSE 'default' END AS origin FROM method LEFT JOIN contract c USING (m) LEFT JOIN (SELECT sub AS m, max(strength) AS strength FROM override_edge JOIN contract ON contract.m = sup GROUP BY 1) i USING (m) LEFT JOIN (SELECT t, nullif(hint, 0) AS hint FROM typ) h ON h.t = owner")
def shallow_defaults(f: Facts) -> DataFrame:
    """A value with its origin: contract, inherited, type, default."""
    c = f.contract.select("m", F.col("strength").alias("c"))
    i = f.override_edge.join(f.contract, F.col("sup") == F.col("m")).groupBy(F.col("sub").alias("m")).agg(F.max("strength").alias("i"))
    h = f.typ.select(F.col("t").alias("owner"), F.expr("nullif(hint, 0)").alias("h"))
    x = f.method.select("m", "owner").join(c, "m", "left").join(i, "m", "left").join(h, "owner", "left")
    origin = F.when(F.col("c").isNotNull(), "contract").when(F.col("i").isNotNull(), "inherited").when(F.col("h").isNotNull(), "type").otherwise("default")
    return x.select("m", F.coalesce("c", "i", "h", F.lit(0)).cast("long").alias("value"), origin.alias("origin"))


@query("SELECT package, m.m % 100 AS name, min(c.m) AS target FROM method m JOIN contract c ON c.m % 100 = m.m % 100 AND c.strength > 2 GROUP BY 1, 2")
def hint_match(f: Facts) -> DataFrame:
    """Each hint member's one library member, by a total order."""
    c = f.contract.where("strength > 2").select((F.col("m") % 100).alias("name"), F.col("m").alias("target"))
    return links.choose(f.method.select("package", (F.col("m") % 100).alias("name")).join(c, "name").select("package", "name", "target"), ["package", "name"], "target")


@query("SELECT 'container' AS category, t AS elem_id, count(*) AS causes FROM typ JOIN method ON owner = t JOIN param USING (m) WHERE hint = 3 AND NOT is_private AND NOT unmodified GROUP BY 2")
def guard_container(f: Facts) -> DataFrame:
    """Types declared containers with a decided modification of a parameter."""
    x = f.typ.where("hint = 3").join(f.method.where("not is_private"), F.col("owner") == F.col("t")).join(f.param.where("not unmodified"), "m")
    return x.groupBy(F.col("t").alias("elem_id")).agg(F.count(F.lit(1)).alias("causes")).select(F.lit("container").alias("category"), "elem_id", "causes")


@query(_RULES + ", r AS (SELECT t, CASE WHEN immutable = 0 THEN 'assignable' WHEN immutable = 1 THEN 'rules' END AS rule, hint FROM v JOIN typ USING (t)) SELECT t AS elem_id, rule FROM r WHERE hint = 3 AND rule IS NOT NULL")
def guard_immutable(f: Facts) -> DataFrame:
    """Types declared immutable that are not, with the rule that fails."""
    rule = F.when(F.col("immutable") == 0, "assignable").when(F.col("immutable") == 1, "rules")
    return _immutable(f).join(f.typ.select("t", "hint"), "t").where("hint = 3").select(F.col("t").alias("elem_id"), rule.alias("rule")).where("rule is not null")


@query("SELECT o.sub, o.sup FROM override_edge o JOIN contract a ON a.m = o.sub JOIN contract b ON b.m = o.sup WHERE a.strength < b.strength")
def guard_override(f: Facts) -> DataFrame:
    """Overrides that promise less than what they override."""
    a, b = f.contract.select(F.col("m").alias("sub"), F.col("strength").alias("a")), f.contract.select(F.col("m").alias("sup"), F.col("strength").alias("b"))
    return f.override_edge.join(a, "sub").join(b, "sup").where("a < b").select("sub", "sup")


@query("WITH n AS (SELECT owner AS t, count(*) FILTER (NOT unmodified) AS blocking, count(*) AS total FROM method JOIN param USING (m) WHERE NOT is_private GROUP BY 1) SELECT t, blocking, total, row_number() OVER (ORDER BY blocking, total DESC, t) AS rank FROM n WHERE blocking > 0 ORDER BY rank LIMIT 10")
def near_miss_topk(f: Facts) -> DataFrame:
    """The ten types nearest to being containers."""
    n = f.method.where("not is_private").join(f.param, "m").groupBy(F.col("owner").alias("t")).agg(F.sum(F.coalesce((~F.col("unmodified")).cast("int"), F.lit(0))).alias("blocking"), F.count(F.lit(1)).alias("total"))
    return fixpoint.top(n.where("blocking > 0"), 10, "blocking", F.desc("total"), "t")


_NULL = "WITH RECURSIVE r(node) AS (SELECT node FROM seed WHERE node NOT IN (SELECT m FROM contract) UNION SELECT e.dst FROM r JOIN call_edge e ON e.src = r.node WHERE e.dst NOT IN (SELECT m FROM contract))"


def _nulls(f: Facts) -> DataFrame:
    return fixpoint.null_reach(f.call_edge, f.seed, f.contract.select(F.col("m").alias("node"))).select("node")


def _null_verdict(f: Facts) -> DataFrame:
    hit = _nulls(f).select(F.col("node").alias("m"), F.lit(True).alias("hit"))
    bound = f.contract.select("m", F.lit(True).alias("bound"))
    state = F.when(F.col("bound"), "NONNULL").when(F.col("hit"), "NULLABLE").when(F.col("immutable_type"), "UNSPECIFIED").otherwise("NONNULL")
    return f.method.select("m", "immutable_type", "non_modifying").join(hit, "m", "left").join(bound, "m", "left").select("m", "non_modifying", state.alias("state"))


_VERDICT = _NULL + ", v AS (SELECT m, non_modifying, CASE WHEN m IN (SELECT m FROM contract) THEN 'NONNULL' WHEN m IN (SELECT node FROM r) THEN 'NULLABLE' WHEN immutable_type THEN 'UNSPECIFIED' ELSE 'NONNULL' END AS state FROM method)"


@query(_NULL + " SELECT node FROM r")
def null_reach(f: Facts) -> DataFrame:
    """Null flow with contracts as cuts on the target and no contracted seeds."""
    return _nulls(f)


@query(_VERDICT + " SELECT m, state FROM v")
def null_verdict(f: Facts) -> DataFrame:
    """Nullness states by ordered rules."""
    return _null_verdict(f).select("m", "state")


@query(_VERDICT + ", o AS (SELECT CASE WHEN non_modifying IS NULL THEN 'UNSPECIFIED' WHEN non_modifying THEN 'NULLABLE' ELSE 'NONNULL' END AS ref, state FROM v) SELECT CASE WHEN ref = 'UNSPECIFIED' THEN 'UNSCORED' WHEN state = 'UNSPECIFIED' THEN 'UNDECIDED' WHEN ref = state THEN 'AGREE' WHEN ref = 'NULLABLE' THEN 'UNSAFE' ELSE 'NOISE' END AS outcome, count(*) AS n FROM o GROUP BY 1")
def null_confusion(f: Facts) -> DataFrame:
    """Verdicts against a reference, by outcome."""
    ref = F.when(F.col("non_modifying").isNull(), "UNSPECIFIED").when(F.col("non_modifying"), "NULLABLE").otherwise("NONNULL")
    return _null_verdict(f).groupBy(lattice.null_outcome(ref, F.col("state")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE e(a, b) AS (SELECT src, dst FROM call_edge WHERE dst NOT IN (SELECT m FROM contract)), s(node) AS (SELECT node FROM seed WHERE node NOT IN (SELECT m FROM contract)),
own(node) AS (SELECT node FROM s UNION SELECT e.b FROM own JOIN e ON e.a = own.node),
g(a, b) AS (SELECT a, b FROM e UNION SELECT a.var, c.caller FROM call_site c JOIN call_arg a USING (site) JOIN summary_link l ON l.m = c.callee AND l.from_pos = a.pos AND l.to_pos = 1 WHERE c.caller NOT IN (SELECT m FROM contract)),
r(node) AS (SELECT node FROM s UNION SELECT c.caller FROM call_site c JOIN own ON own.node = c.callee WHERE c.caller NOT IN (SELECT m FROM contract) UNION SELECT g.b FROM r JOIN g ON g.a = r.node)
SELECT DISTINCT node FROM r
""")
def null_reach_gated(f: Facts) -> DataFrame:
    """Null flow in which a call's result opens by the callee alone or by this call's arguments."""
    through = f.summary_link.where("to_pos = 1").select(F.col("m").alias("callee"), F.col("from_pos").alias("pos"))
    return fixpoint.gated_null_reach(f.call_edge, f.seed, f.contract.select(F.col("m").alias("node")), f.call_site.select("site", "callee", F.col("caller").alias("result")), f.call_arg.select("site", "pos", F.col("var").alias("node")), through).select("node")


@query("SELECT sub AS src, sup AS dst, 'return' AS slot FROM override_edge UNION ALL SELECT sub, sup, 'param' FROM override_edge UNION ALL SELECT sup, sub, 'param' FROM override_edge")
def override_null_edges(f: Facts) -> DataFrame:
    """Returns flow up an override, parameters both ways."""
    up = f.override_edge.select(F.col("sub").alias("src"), F.col("sup").alias("dst"))
    down = f.override_edge.select(F.col("sup").alias("src"), F.col("sub").alias("dst"))
    return up.withColumn("slot", F.lit("return")).unionByName(up.withColumn("slot", F.lit("param"))).unionByName(down.withColumn("slot", F.lit("param")))


@query("SELECT DISTINCT a.f, a.m AS writer, r.m AS reader FROM assignment a JOIN reads r ON r.f = a.f AND r.m % 16 = a.m % 16")
def keyed_slots(f: Facts) -> DataFrame:
    """What is stored under a key joined with what is read under it."""
    a, r = f.assignment.select("f", F.col("m").alias("writer")), f.reads.select("f", F.col("m").alias("reader"))
    return a.join(r, "f").where("writer % 16 = reader % 16").distinct()


@query("SELECT m, bool_and(coalesce(unmodified, false)) AS precondition FROM param GROUP BY 1")
def preconditions(f: Facts) -> DataFrame:
    """Families whose every member tolerates the demand."""
    return f.param.groupBy("m").agg(lattice.all_or_false(F.col("unmodified")).alias("precondition"))


@query("WITH RECURSIVE d(m) AS (SELECT DISTINCT m FROM edit WHERE kind = 'purchase' UNION SELECT o.sub FROM d JOIN override_edge o ON o.sup = d.m) SELECT m AS node FROM d")
def incremental_dirty(f: Facts) -> DataFrame:
    """What must be recomputed after edits."""
    seeds = f.edit.where("kind = 'purchase'").select(F.col("m").alias("node"))
    return fixpoint.reach(f.override_edge.select(F.col("sup").alias("src"), F.col("sub").alias("dst")), seeds).select("node")


@query("WITH RECURSIVE d(m) AS (SELECT DISTINCT m FROM edit WHERE kind = 'purchase' UNION SELECT o.sub FROM d JOIN override_edge o ON o.sup = d.m WHERE d.m % 3 = 0) SELECT m AS node, m % 3 = 0 AS changed FROM d")
def early_cutoff(f: Facts) -> DataFrame:
    """Recomputation stops where the output's fingerprint is the old one."""
    seeds = f.edit.where("kind = 'purchase'").select(F.col("m").alias("node"))
    prior = f.method.select(F.col("m").alias("node"), F.col("m").alias("fp"))
    made = lambda nodes: nodes.select("node", F.when(F.col("node") % 3 == 0, -F.col("node") - 1).otherwise(F.col("node")).alias("fp"))
    return fixpoint.early_cutoff(seeds, f.override_edge.select(F.col("sub").alias("user"), F.col("sup").alias("used")), prior, made).select("node", "changed")


@query("SELECT owner AS t, sha256(string_agg(line, chr(10) ORDER BY line)) AS fp FROM (SELECT owner, regexp_replace(m || ':' || '\"' || m || '-1:' || m || '-9\"', '\"[0-9]+-[0-9]+:[0-9]+-[0-9]+\"', '\"\"', 'g') AS line FROM method) GROUP BY 1")
def fingerprint_type(f: Facts) -> DataFrame:
    """A type's fingerprint, whatever the order of its members and their positions."""
    m = F.col("m").cast("string")
    line = scalars.without_positions(F.concat(m, F.lit(':"'), m, F.lit("-1:"), m, F.lit('-9"')))
    return f.method.select("owner", line.alias("line")).groupBy(F.col("owner").alias("t")).agg(scalars.fingerprint(F.col("line")).alias("fp"))


@query("SELECT p, m FROM param WHERE m NOT IN (SELECT src FROM call_edge)")
def missing_elements(f: Facts) -> DataFrame:
    """Rows whose element has no facts; they taint, they are no seeds."""
    return f.param.select("p", "m").join(f.call_edge.select(F.col("src").alias("m")), "m", "left_anti").select("p", "m")


@query("SELECT nature, count(*) AS n FROM summary_link GROUP BY 1 ORDER BY n DESC, nature LIMIT 5")
def missing_link_census(f: Facts) -> DataFrame:
    """The five most frequent kinds."""
    return f.summary_link.groupBy("nature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "nature").limit(5)


@query("SELECT t, count(c.m) AS n FROM typ LEFT JOIN (SELECT m, owner FROM method JOIN contract USING (m)) c ON c.owner = t GROUP BY 1")
def sink_census(f: Facts) -> DataFrame:
    """Counts that show zeros."""
    c = f.method.join(f.contract, "m").groupBy(F.col("owner").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return f.typ.select("t").join(c, "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT coalesce(a.m, b.m) AS m, CASE WHEN a.m IS NULL THEN 'evidence' WHEN b.m IS NULL THEN 'verdict' WHEN a.non_modifying = (b.n < 3) THEN 'agree' WHEN a.non_modifying IS NULL THEN 'undecided' ELSE 'differ' END AS outcome FROM (SELECT m, non_modifying FROM method) a FULL JOIN (SELECT m, count(*) AS n FROM edit GROUP BY 1) b ON a.m = b.m")
def evidence_join(f: Facts) -> DataFrame:
    """Verdicts joined with outside evidence."""
    a = f.method.select("m", "non_modifying", F.lit(True).alias("has_a"))
    b = f.edit.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("has_a").isNull(), "evidence").when(F.col("n").isNull(), "verdict").when(F.col("non_modifying") == (F.col("n") < 3), "agree").when(F.col("non_modifying").isNull(), "undecided").otherwise("differ")
    return a.join(b, "m", "full_outer").select("m", outcome.alias("outcome"))
