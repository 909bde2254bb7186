"""Operators on ten-row fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import algebra, scalars
from verdigraph.operators import components, fixpoint, lattice, links, verdict_rules


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_reach_with_cycles_nulls_and_cuts(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (None, 9), (9, None), (7, 8)])
    assert {r.node: r.level for r in fixpoint.reach(e, nodes(spark, [1, None])).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert {r.node for r in fixpoint.reach(e, nodes(spark, [1]), nodes(spark, [3])).collect()} == {1, 2, 3}
    assert fixpoint.reach(e, nodes(spark, [])).count() == 0
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.reach(e, nodes(spark, [1]), max_rounds=2)


def test_capture_chain(spark):
    """Five classes hand a list on; the last one changes it, so all are reached, and only they."""
    chain = [(10 * k + 1, 10 * k) for k in range(1, 6)] + [(10 * k + 11, 10 * k + 1) for k in range(1, 5)]
    reached = {r.node for r in fixpoint.reach(edges(spark, [(b, a) for a, b in chain]), nodes(spark, [10])).collect()}
    assert reached == {10} | {10 * k + 1 for k in range(1, 6)}


def test_link_closure_states(spark):
    a, b, c, d = 1, 2, 3, 4
    same, member = algebra.RANK["≡"], algebra.RANK["∈"]
    table, mirror = algebra.table(spark), algebra.natures(spark).select("nature", "reverse")
    base = [(a, same, b), (b, same, c), (a, member, d)]
    got = fixpoint.labelled_closure(spark.createDataFrame(base, "src long, nature int, dst long"), table, mirror)
    found = {(r.src, algebra.NATURES[r.nature - 1], r.dst) for r in links.best(got).collect()}
    want = {(x, "≡", y) for x, y in itertools.permutations((a, b, c), 2)} | {(x, "∈", d) for x in (a, b, c)} | {(d, "∋", x) for x in (a, b, c)}
    assert found == want
    left = fixpoint.retract(spark.createDataFrame(base, "src long, nature int, dst long"), spark.createDataFrame([base[1]], "src long, nature int, dst long"), table, mirror)
    assert {(r.src, r.dst) for r in left.collect()} == {(a, b), (b, a), (a, d), (d, a), (b, d), (d, b)}


def test_closure_does_not_depend_on_order(spark):
    table, mirror = algebra.table(spark), algebra.natures(spark).select("nature", "reverse")
    base = [(1, algebra.RANK["~"], 2), (2, algebra.RANK["∋"], 3), (3, algebra.RANK["←"], 4), (1, algebra.RANK["⊆"], 4)]
    results = set()
    for seed in range(3):
        shuffled = random.Random(seed).sample(base, len(base))
        got = fixpoint.labelled_closure(spark.createDataFrame(shuffled, "src long, nature int, dst long"), table, mirror)
        results.add(frozenset(tuple(r) for r in got.collect()))
    assert len(results) == 1


def test_algebra_turns_round():
    for r, s in itertools.product(algebra.NATURES, repeat=2):
        t = algebra.combine(r, s)
        if t:
            assert algebra.combine(algebra.REVERSE[s], algebra.REVERSE[r]) == algebra.REVERSE[t]
    assert algebra.combine("≡", "∈") == "∈" and algebra.combine("→", "←") is None


def test_waves_and_components(spark):
    root = components.roots(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long"))
    assert {r.u: r.v for r in root.collect()} == {2: 1, 3: 1, 6: 5}
    cycle = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    got = fixpoint.waves(edges(spark, [(1, 2), (2, 1), (3, 1), (4, 3), (4, 5)]), nodes(spark, range(1, 6)), cycle)
    assert {r.node: r.wave for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.waves(edges(spark, [(1, 2), (2, 1)]), nodes(spark, [1, 2]), cycle.limit(0), max_rounds=5)


@pytest.mark.parametrize("differs,recomputed", [(set(), {"A"}), ({"A", "B"}, {"A", "B", "C"}), (set("ABCD"), set("ABCD"))])
def test_early_cutoff(spark, differs, recomputed):
    ids = {c: i for i, c in enumerate("ABCD")}
    depends = spark.createDataFrame([(ids[b], ids[a]) for a, b in ("AB", "BC", "CD")], "user long, used long")
    prior = spark.createDataFrame([(i, "old") for i in ids.values()], "node long, fp string")
    fresh = spark.createDataFrame([(i, "new" if c in differs else "old") for c, i in ids.items()], "node long, fp string")
    got = fixpoint.early_cutoff(nodes(spark, [0]), depends, prior, lambda df: df.join(fresh, "node"))
    assert {r.node for r in got.collect()} == {ids[c] for c in recomputed}


def test_greatest_fixpoint_equals_brute_force(spark):
    r = random.Random(3)
    members, needs = set(range(20)), [(r.randrange(20), r.randrange(26)) for _ in range(18)]
    left = set(members)
    while bad := {n for n, m in needs if n in left and m not in left}:
        left -= bad
    got = fixpoint.greatest(nodes(spark, members), spark.createDataFrame(needs, "node long, needs long"))
    assert {x.node for x in got.collect()} == left


def test_three_valued_folds(spark):
    rows = [(1, True), (1, None), (2, False), (2, None), (3, True), (4, None)]
    df = spark.createDataFrame(rows, "g int, v boolean")
    got = {x.g: (x.f, x.w) for x in df.groupBy("g").agg(lattice.all_or_false(F.col("v")).alias("f"), lattice.all_or_wait(F.col("v")).alias("w")).collect()}
    assert got == {1: (False, None), 2: (False, False), 3: (True, True), 4: (False, None)}
    levels = spark.createDataFrame([(1, 0), (1, None), (2, 1), (2, None), (3, 2), (3, 1)], "g int, v int")
    got = {x.g: (x.w, x.b) for x in levels.groupBy("g").agg(lattice.least_or_wait(F.col("v")).alias("w"), lattice.least_or_bottom(F.col("v"), 0).alias("b")).collect()}
    assert got == {1: (None, 0), 2: (None, None), 3: (1, 1)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "k", 2), (2, "k", None), (3, "k", 1), (4, "k", 3)], "elem_id long, key string, value int")
    new = spark.createDataFrame([(1, "k", 1), (2, "k", 1), (3, "k", 2), (5, "k", 0)], "elem_id long, key string, value int")
    got = {x.elem_id: (x.value, x.refused) for x in lattice.upsert(old, new, F.col("after") > F.col("before")).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (2, False), 4: (3, False), 5: (0, False)}


def test_null_outcomes(spark):
    states = ["UNSPECIFIED", "NULLABLE", "NONNULL"]
    df = spark.createDataFrame(list(itertools.product(states, states)), "ref string, v string")
    got = {(x.ref, x.v): x.o for x in df.select("ref", "v", lattice.null_outcome(F.col("ref"), F.col("v")).alias("o")).collect()}
    assert got[("NULLABLE", "NONNULL")] == "UNSAFE" and got[("NONNULL", "NULLABLE")] == "NOISE" and got[("NONNULL", "NONNULL")] == "AGREE"
    assert {got[("UNSPECIFIED", s)] for s in states} == {"UNSCORED"} and got[("NONNULL", "UNSPECIFIED")] == "UNDECIDED"


def test_a_gate_opens_by_its_own_argument_only(spark):
    """Callee 2 returns null by itself; callee 3 hands its first parameter on."""
    empty = nodes(spark, [])
    calls = spark.createDataFrame([(10, 2, 20), (11, 3, 21), (12, 3, 22), (13, 3, 23)], "site long, callee long, result long")
    args = spark.createDataFrame([(11, 1, 1), (12, 1, 7), (13, 2, 1)], "site long, pos int, node long")
    through = spark.createDataFrame([(3, 1)], "callee long, pos int")
    got = lambda contracts: {x.node for x in fixpoint.gated_null_reach(edges(spark, [(1, 2), (21, 30)]), nodes(spark, [1]), contracts, calls, args, through).collect()}
    assert got(empty) == {1, 2, 20, 21, 30}
    assert got(nodes(spark, [21])) == {1, 2, 20}


def test_both_ways_to_reach_agree(spark, monkeypatch):
    r = random.Random(3)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(90)]
    few = {x.node: x.level for x in fixpoint.reach(edges(spark, e), nodes(spark, [0, 1])).collect()}
    monkeypatch.setattr(fixpoint, "SMALL_EDGES", 0)
    assert {x.node: x.level for x in fixpoint.reach(edges(spark, e), nodes(spark, [0, 1])).collect()} == few
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.reach(edges(spark, [(1, 2), (2, 3), (3, 4)]), nodes(spark, [1]), max_rounds=2)


def test_flow_of_statements(spark):
    r = random.Random(5)
    rows = [(i, i // 3 if i else None, r.choice(["plain", "plain", "return", "break"]), r.random() < 0.4, r.random() < 0.5) for i in range(1, 80)] + [(0, None, "plain", False, False)]
    rows = [(s, p if s else None, leaf, loop, inf) for s, p, leaf, loop, inf in rows]
    below = {s: sorted(t for t, p, *_ in rows if p == s) for s, *_ in rows}
    known = {s: (leaf, loop, inf) for s, _, leaf, loop, inf in rows}

    def flow(s):
        leaf, loop, infinite = known[s]
        if not below[s]:
            return leaf == "plain", leaf == "break"
        falls, breaks = True, False
        for c in below[s]:
            f, b = flow(c)
            if falls:
                breaks, falls = breaks or b, f
        return (not infinite or breaks, False) if loop else (falls, breaks)

    got = verdict_rules.flow(spark.createDataFrame(rows, "s long, parent long, leaf string, is_loop boolean, infinite boolean"))
    assert {x.s: (x.falls_through, x.breaks_out) for x in got.collect()} == {s: flow(s) for s in known}


def test_scalars(spark):
    df = spark.createDataFrame([("1", "1.0.2"), ("", "3"), ("1", "10"), ("1.0", "1.1.0")], "a string, b string")
    got = df.select(scalars.in_scope_of(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False]
    one = spark.createDataFrame([('{"x":"3-4:5-16"}',)], "s string").select(scalars.without_positions(F.col("s")).alias("s"), scalars.snake(F.lit("fooBarX")).alias("n")).first()
    assert (one.s, one.n) == ('{"x":""}', "foo_bar_x")
    assert df.agg(scalars.fingerprint(F.col("b")).alias("h")).first() == df.orderBy(F.desc("b")).agg(scalars.fingerprint(F.col("b")).alias("h")).first()


def test_ancestors_of_any_depth(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(16)], "var long, parent long")
    got = sorted(tuple(r) for r in links.ancestors(chain).select("var", "anc", "depth").collect())
    assert got == sorted((k, k - d, d) for k in range(16) for d in range(k + 1))
    with pytest.raises(fixpoint.NotConverged):
        links.ancestors(chain, max_rounds=5)


def test_well_founded_leaves_cycles_and_what_stands_on_them(spark):
    needs = spark.createDataFrame([(2, 1), (2, 1), (3, 2), (4, 5), (5, 4), (6, 5), (6, 1), (7, 99), (None, 1)], "node long, needs long")
    assert {r.node for r in fixpoint.well_founded(nodes(spark, [1, 2, 3, 4, 5, 6, 7, None]), needs).collect()} == {1, 2, 3}
    assert fixpoint.well_founded(nodes(spark, []), needs).count() == 0
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.well_founded(nodes(spark, [1, 2, 3]), needs, max_rounds=2)


def test_outer_rounds_stop_when_nothing_changes_or_at_the_limit(spark):
    step = lambda df: df.select(F.explode(F.array("node", F.least(F.col("node") + 1, F.lit(4)))).alias("node"))
    assert {r.node for r in fixpoint.outer_rounds(step, nodes(spark, [0]), 3).collect()} == {0, 1, 2, 3}
    assert {r.node for r in fixpoint.outer_rounds(step, nodes(spark, [0, 0]), 50).collect()} == {0, 1, 2, 3, 4}
    assert fixpoint.outer_rounds(step, nodes(spark, []), 3).count() == 0


def test_lifted_elements(spark):
    table, rank = algebra.table(spark), algebra.RANK
    lift = lambda base, mods=(): {tuple(r) for r in links.lift_elements(
        spark.createDataFrame(base, "src long, nature int, dst long"), spark.createDataFrame([(11, 10), (12, 11), (21, 20)], "var long, whole long"),
        spark.createDataFrame([(m,) for m in mods], "var long"), table, rank["∈"], rank["∋"]).collect()}
    up = lambda r: algebra.RANK[algebra.combine(r, "∈")]
    assert lift([(1, rank["≡"], 12), (1, rank["≡"], 12), (1, rank["≡"], 2)]) == {(1, rank["∈"], 10), (1, rank["≡"], 2)}
    assert lift([(11, rank["≡"], 1)]) == {(10, rank["∋"], 1)}
    assert lift([(11, rank["≡"], 21)]) == {(10, algebra.RANK[algebra.combine("∋", "∈")], 20)}
    assert lift([(11, rank["≡"], 10), (1, rank["↗"], 11)]) == set()  # itself; nothing composes
    assert lift([(1, rank["≡"], 11), (1, rank["≡"], 2)], [1]) == {(1, rank["≡"], 2)}
    assert up("≡") == rank["∈"] and lift([]) == set()


def test_standard_functional_types(spark):
    rows = spark.createDataFrame([("a.b.C", "a.b"), ("java.util.function.Function", "java.util.function"), ("kotlin.jvm.functions.Function2", "kotlin.jvm.functions"), (None, None)], "n string, p string")
    assert [r[0] for r in rows.select(scalars.is_standard_functional(F.col("n"), F.col("p"))).collect()] == [False, True, True, False]
