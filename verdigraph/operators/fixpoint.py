"""Recursive operators: semi-naive loops over written deltas, and what is built on them.

Each round joins only the last delta with the edges and removes what is known, so a round costs its
delta. Deltas are written tables: lineage stays short and a lost executor repeats one round at most.
Results are least fixpoints over sets, so they do not depend on evaluation order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.runtime import durable

MAX_ROUNDS = 1_000
#: Edges up to which one task walks a graph: 16 bytes each, 64 MB in all, whatever they are taken from.
SMALL_EDGES = 4_000_000


class NotConverged(RuntimeError):
    """A loop passed its round limit; its partial result is not returned."""


def _all(deltas: list[DataFrame]) -> DataFrame:
    """The union of written tables of one schema, as one scan of their files."""
    return deltas[0].sparkSession.read.schema(deltas[0].schema).parquet(*(d._verdigraph_path for d in deltas))


def reach(edges: DataFrame, seeds: DataFrame, absorbing: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, level): nodes reachable from ``seeds`` (node) over ``edges`` (src, dst), fewest steps.

    ``absorbing`` (node) are reached but not left. Nulls in edges and seeds are ignored; repeated rows
    count once; without seeds there are no rows. A graph that was counted to have SMALL_EDGES edges at
    most (and as many seeds) is walked by one task in one job; a larger one level by level, where a
    level's cost is its own nodes' edges and the known nodes' files, which are merged geometrically.
    """
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    if absorbing is not None:
        steps = steps.join(absorbing.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    steps = durable(steps, "edges")
    first = durable(seeds.select("node").where("node is not null").distinct().withColumn("level", F.lit(0)), "reach")
    kind = {*(dict(x.dtypes)[c] for x, c in ((steps, "src"), (steps, "dst"), (first, "node")))}
    if kind <= {"bigint", "int"} and steps.count() <= SMALL_EDGES and first.count() <= SMALL_EDGES:
        return _walked(steps, first, max_rounds)
    found, sizes = [first], [first.count()]
    delta, level = first, 0
    while sizes[-1] and delta.count():
        level += 1
        if level > max_rounds:
            raise NotConverged(f"reachability is not complete after {max_rounds} rounds")
        met = delta.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        delta = durable(met.join(_all(found).select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "reach")
        if not (n := delta.count()):
            break
        found.append(delta)
        sizes.append(n)
        while len(found) > 1 and sizes[-2] < 2 * sizes[-1]:
            n = sizes.pop() + sizes.pop()
            found = [*found[:-2], durable(_all(found[-2:]), "reach")]
            sizes.append(n)
    return _all(found)


def _walked(steps: DataFrame, first: DataFrame, max_rounds: int) -> DataFrame:
    """``reach`` over a graph of counted, small size: breadth-first over sorted edges, in one task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.asarray(b.column("src")), b.column("dst")) for b in batches]
        src = np.concatenate([np.zeros(0, "i8"), *(s for s, _ in ends)])
        seed = np.concatenate([np.zeros(0, bool), *(np.asarray(d.is_null()) for _, d in ends)])
        dst = np.concatenate([np.zeros(0, "i8"), *(np.asarray(d.fill_null(0)) for _, d in ends)])
        names, place = np.unique(np.concatenate([src, dst[~seed]]), return_inverse=True)
        a, b = place[: len(src)], np.zeros(len(src), "i8")
        b[~seed] = place[len(src) :]
        frontier = np.unique(a[seed])
        order = np.argsort(a[~seed], kind="stable")
        a, b = a[~seed][order], b[~seed][order]
        start = np.searchsorted(a, np.arange(len(names) + 1))
        level = np.full(len(names), -1, "i4")
        at = 0
        while len(frontier):
            if at > max_rounds:
                raise NotConverged(f"reachability is not complete after {max_rounds} rounds")
            level[frontier] = at
            at += 1
            n = start[frontier + 1] - start[frontier]
            edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[frontier], n)
            met = np.unique(b[edge])
            frontier = met[level[met] < 0]
        got = level >= 0
        yield pa.RecordBatch.from_arrays([pa.array(names[got]), pa.array(level[got])], names=["node", "level"])

    both = steps.select(F.col("src").cast("long"), F.col("dst").cast("long")).unionByName(first.select(F.col("node").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")))
    try:
        out = durable(both.coalesce(1).mapInArrow(walk, "node long, level int"), "reach")
    except PythonException as e:
        if "NotConverged" in str(e):
            raise NotConverged(f"reachability is not complete after {max_rounds} rounds") from e
        raise
    return out.select(F.col("node").cast(dict(first.dtypes)["node"]).alias("node"), "level")


def causes(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, level, cause): the smallest predecessor one level nearer to a seed; null for seeds."""
    before = reached.select(F.col("node").alias("src"), (F.col("level") + 1).alias("level"))
    via = edges.select("src", F.col("dst").alias("node")).join(before, "src").groupBy("node", "level").agg(F.min("src").alias("cause"))
    return reached.join(via, ["node", "level"], "left").select("node", "level", "cause")


def cause_chain(caused: DataFrame, elements: DataFrame, most: int) -> DataFrame:
    """(elem, pos, node): the steps from each element back towards a seed, ``most`` at most."""
    at = durable(elements.select(F.col("node").alias("elem"), F.lit(0).alias("pos"), "node"), "chain")
    steps = [at]
    links = durable(caused.where("cause is not null").select("node", "cause"), "causes")
    for pos in range(1, most):
        at = durable(at.join(links, "node").select("elem", F.lit(pos).alias("pos"), F.col("cause").alias("node")), "chain")
        if at.isEmpty():
            break
        steps.append(at)
    return _all(steps)


def pairs(edges: DataFrame, start: DataFrame, max_rounds: int = MAX_ROUNDS, through_owner: bool = True) -> DataFrame:
    """(owner, node): owners carried along edges (src, dst) from ``start`` (owner, node), to fixpoint.

    Unless ``through_owner``, no owner is carried to its own node, so nothing is reached by way of it
    either; ``start`` stays as given.
    """
    steps = durable(edges.select("src", "dst").distinct(), "edges")
    deltas = [durable(start.select("owner", "node").distinct(), "pairs")]
    while not deltas[-1].isEmpty():
        if len(deltas) > max_rounds:
            raise NotConverged(f"not complete after {max_rounds} rounds")
        met = deltas[-1].join(steps, F.col("node") == F.col("src")).select("owner", F.col("dst").alias("node")).distinct()
        if not through_owner:
            met = met.where("owner <> node")
        deltas.append(durable(met.join(_all(deltas), ["owner", "node"], "left_anti"), "pairs"))
    return _all(deltas)


def labelled_closure(base: DataFrame, algebra: DataFrame, mirror: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(src, dst, nature): all derivable labels of all pairs.

    ``base`` has (src, nature, dst); ``algebra`` (r, s, t) composes, ``mirror`` (nature, reverse) turns
    a label round; both are dimension tables of fixed size, so they are broadcast. The table need not
    be associative: facts compose with facts on both sides, not only with base links.
    """

    def mirrored(df: DataFrame) -> DataFrame:
        turned = df.join(F.broadcast(mirror), "nature").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("reverse").alias("nature"))
        return df.select("src", "dst", "nature").unionByName(turned).distinct()

    deltas = [durable(mirrored(base.select("src", "dst", "nature")), "closure")]
    while not deltas[-1].isEmpty():
        if len(deltas) > max_rounds:
            raise NotConverged(f"closure is not complete after {max_rounds} rounds")
        new, known = deltas[-1], _all(deltas)
        step = lambda a, b: a.select("src", F.col("dst").alias("mid"), F.col("nature").alias("r")).join(b.select(F.col("src").alias("mid"), "dst", F.col("nature").alias("s")), "mid")
        both = step(new, known).unionByName(step(known, new))
        made = both.where("src <> dst").select("src", "dst", "r", "s").distinct().join(F.broadcast(algebra), ["r", "s"]).select("src", "dst", F.col("t").alias("nature"))
        deltas.append(durable(mirrored(made).join(known, ["src", "dst", "nature"], "left_anti"), "closure"))
    return _all(deltas)


def retract(base: DataFrame, gone: DataFrame, algebra: DataFrame, mirror: DataFrame) -> DataFrame:
    """The closure after links ``gone`` (src, nature, dst) were withdrawn.

    Set semantics make the result equal to the closure of what is left, which is how it is derived:
    support counting saves nothing where every pair may have many derivations.
    """
    return labelled_closure(base.join(gone, ["src", "nature", "dst"], "left_anti"), algebra, mirror)


def waves(edges: DataFrame, nodes: DataFrame, components: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, wave): a node's wave is above those of all it depends on, outside its own component.

    ``edges`` (src depends on dst); ``components`` (node, root) condenses cycles.
    """
    root = nodes.join(components, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    root = durable(root, "roots")
    a, b = root.select(F.col("node").alias("src"), F.col("root").alias("up")), root.select(F.col("node").alias("dst"), F.col("root").alias("down"))
    deps = durable(edges.join(a, "src").join(b, "dst").where("up <> down").select("up", "down").distinct(), "deps")
    wave = durable(root.select("root").distinct().withColumn("wave", F.lit(0)), "wave")
    for _ in range(max_rounds):
        raised = deps.join(wave.select(F.col("root").alias("down"), "wave"), "down").groupBy(F.col("up").alias("root")).agg((F.max("wave") + 1).alias("least"))
        moved = durable(wave.join(raised, "root", "left").select("root", F.greatest("wave", F.coalesce("least", F.lit(0))).alias("wave")), "wave")
        if moved.agg(F.sum("wave")).first() == wave.agg(F.sum("wave")).first():
            return root.join(moved, "root").select("node", "wave")
        wave = moved
    raise NotConverged("the dependency graph has a cycle outside its components")


def greatest(members: DataFrame, assumptions: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Members (node) left after dropping, until stable, whoever assumes (node, needs) a non-member."""
    current = durable(members.select("node").distinct(), "members")
    needs = durable(assumptions.select("node", "needs").distinct(), "needs")
    for _ in range(max_rounds):
        broken = needs.join(current.select(F.col("node").alias("needs")), "needs", "left_anti").select("node").distinct()
        left = durable(current.join(broken, "node", "left_anti"), "members")
        if left.count() == current.count():
            return left
        current = left
    raise NotConverged(f"not stable after {max_rounds} rounds")


def well_founded(members: DataFrame, needs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Members (node) all of whose needs (node, needs) are met in turn, from those without any upwards.

    Members on a cycle or above one are left out, and so are those that need what is no member. Nulls
    are no members; repeated rows count once.
    """
    open_ = durable(members.select("node").where("node is not null").distinct(), "open")
    unmet = durable(needs.select("node", "needs").where("node is not null").distinct(), "needs")
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        found.append(durable(open_.join(unmet.select("node").distinct(), "node", "left_anti"), "founded"))
        if found[-1].isEmpty():
            return _all(found)
        open_ = durable(open_.join(found[-1], "node", "left_anti"), "open")
        unmet = durable(unmet.join(found[-1].select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"), "needs")
    raise NotConverged(f"needs are not met after {max_rounds} rounds")


def outer_rounds(step: Callable[[DataFrame], DataFrame], state: DataFrame, most: int) -> DataFrame:
    """The set that ``step`` makes of ``state``, again and again until it stays, ``most`` times at most.

    Stopping at ``most`` is no failure here: each round only refines the one before. Nulls equal nulls.
    """
    state = durable(state.distinct(), "round")
    for _ in range(most):
        made = durable(step(state).select(state.columns).distinct(), "round")
        if made.count() == state.count() and made.exceptAll(state).isEmpty():
            return made
        state = made
    return state


def early_cutoff(dirty: DataFrame, depends: DataFrame, prior: DataFrame, recompute, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, fp, changed): recomputed nodes; a node wakes its users only if its fingerprint changed.

    ``depends`` has (user, used), ``prior`` (node, fp); ``recompute`` maps a table of nodes to (node,
    fp). Each node is recomputed once.
    """
    known = durable(prior.select("node", F.col("fp").alias("old")), "prior")
    deltas: list[DataFrame] = []
    wave = durable(dirty.select("node").distinct(), "dirty")
    while not wave.isEmpty():
        if len(deltas) > max_rounds:
            raise NotConverged(f"edits still spread after {max_rounds} rounds")
        made = recompute(wave).join(known, "node", "left").select("node", "fp", (~F.col("fp").eqNullSafe(F.col("old"))).alias("changed"))
        deltas.append(durable(made, "recomputed"))
        woken = deltas[-1].where("changed").join(depends, F.col("node") == F.col("used")).select(F.col("user").alias("node")).distinct()
        wave = durable(woken.join(_all(deltas).select("node"), "node", "left_anti"), "dirty")
    return _all(deltas) if deltas else known.select("node", F.col("old").alias("fp"), F.lit(False).alias("changed")).limit(0)


def null_reach(edges: DataFrame, seeds: DataFrame, contracts: DataFrame) -> DataFrame:
    """(node, level): null flow. Contracted nodes are no seeds and are cut where an edge enters them."""
    open_ = edges.join(contracts.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    return reach(open_, seeds.join(contracts.select("node").distinct(), "node", "left_anti"))


def gated_null_reach(edges: DataFrame, seeds: DataFrame, contracts: DataFrame, calls: DataFrame, args: DataFrame, through: DataFrame) -> DataFrame:
    """(node, level): null flow in which calls are gates.

    ``calls`` (site, callee, result): the result may be null if the callee returns null by itself, that
    is without any of its parameters, or if a parameter of it that flows to its return (``through``:
    callee, pos) has an argument (``args``: site, pos, node) at this very call that may be null. So a
    callee that only hands its argument on opens the results of those calls alone that pass null.
    """
    by_itself = null_reach(edges, seeds, contracts).select(F.col("node").alias("callee"))
    opened = calls.join(by_itself, "callee", "left_semi").select(F.col("result").alias("node"))
    at_call = args.join(calls, "site").join(through, ["callee", "pos"], "left_semi").select(F.col("node").cast("long").alias("src"), F.col("result").alias("dst"))
    return null_reach(edges.select("src", "dst").unionByName(at_call), seeds.select("node").unionByName(opened), contracts)


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows with their rank; a bounded report, by heap in each partition."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
