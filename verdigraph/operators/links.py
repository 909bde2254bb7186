"""Operators on links (src, nature, dst): composition, extraction, groups and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.operators.fixpoint import MAX_ROUNDS, NotConverged, _all
from verdigraph.runtime import durable


def compose(left: DataFrame, right: DataFrame, algebra: DataFrame) -> DataFrame:
    """All a -> c from a -r-> b and b -s-> c with r and s composing; no loops."""
    a = left.select("src", F.col("nature").alias("r"), F.col("dst").alias("mid"))
    b = right.select(F.col("src").alias("mid"), F.col("nature").alias("s"), "dst")
    return a.join(b, "mid").where("src <> dst").join(F.broadcast(algebra), ["r", "s"]).select("src", F.col("t").alias("nature"), "dst").distinct()


def best(links: DataFrame) -> DataFrame:
    """The label of highest rank for each pair."""
    return links.groupBy("src", "dst").agg(F.max("nature").alias("nature"))


def translate(links: DataFrame, translation: DataFrame) -> DataFrame:
    """Links with both ends renamed where ``translation`` (from_var, to_var) has them."""
    t = translation.select("from_var", "to_var")
    out = links.join(t.withColumnRenamed("from_var", "src").withColumnRenamed("to_var", "new_src"), "src", "left")
    out = out.join(t.withColumnRenamed("from_var", "dst").withColumnRenamed("to_var", "new_dst"), "dst", "left")
    return out.select(F.coalesce("new_src", "src").alias("src"), "nature", F.coalesce("new_dst", "dst").alias("dst"))


def apply_summaries(sites: DataFrame, args: DataFrame, summaries: DataFrame) -> DataFrame:
    """(site, src, nature, dst): each callee's summary links between the arguments of each call.

    ``sites`` (site, callee), ``args`` (site, pos, var), ``summaries`` (m, from_pos, nature, to_pos).
    """
    bound = sites.join(summaries, sites["callee"] == summaries["m"]).select("site", "from_pos", "nature", "to_pos")
    a = args.select("site", F.col("pos").alias("from_pos"), F.col("var").alias("src"))
    b = args.select("site", F.col("pos").alias("to_pos"), F.col("var").alias("dst"))
    return bound.join(a, ["site", "from_pos"]).join(b, ["site", "to_pos"]).select("site", "src", "nature", "dst").distinct()


def without_reverses(links: DataFrame, mirror: DataFrame) -> DataFrame:
    """Of a link and its reverse, the one from the smaller end."""
    turned = links.join(F.broadcast(mirror), "nature").select(F.col("dst").alias("src"), F.col("reverse").alias("nature"), F.col("src").alias("dst"))
    doubled = links.join(turned, ["src", "nature", "dst"], "left_semi").where("src > dst")
    return links.join(doubled, ["src", "nature", "dst"], "left_anti")


def transitive_reduction(links: DataFrame) -> DataFrame:
    """Links of one nature without those that two others of it imply (for transitive natures)."""
    a = links.select("nature", "src", F.col("dst").alias("mid"))
    b = links.select("nature", F.col("src").alias("mid"), "dst")
    implied = a.join(b, ["nature", "mid"]).where("src <> mid and mid <> dst").select("src", "nature", "dst").distinct()
    return links.join(implied, ["src", "nature", "dst"], "left_anti")


def complete_slices(slices: DataFrame, needed: int) -> DataFrame:
    """Relational division: (container, target) with a link from every one of ``needed`` slices."""
    return slices.groupBy("container", "target").agg(F.countDistinct("slice").alias("n")).where(F.col("n") == needed).select("container", "target")


def join_groups(alternatives: DataFrame) -> DataFrame:
    """(var, grp): members that stay in their group when alternatives (alt, var, grp, is_source) join.

    A member stays if all alternatives that group it name one group, and every alternative groups it
    or it is only ever a source.
    """
    n = alternatives.select(F.countDistinct("alt").alias("n_alt"))
    by_var = alternatives.groupBy("var").agg(F.countDistinct("grp").alias("groups"), F.countDistinct("alt").alias("alts"), F.min("is_source").alias("source"), F.min("grp").alias("grp"))
    return by_var.join(F.broadcast(n)).where("groups = 1 and (alts = n_alt or source)").select("var", "grp")


def ancestors(variables: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(var, anc, depth): all scopes of each variable (var, parent), itself at depth 0."""
    edge = durable(variables.where("parent is not null").select(F.col("var").alias("anc"), "parent"), "parents")
    levels = [durable(variables.select("var", F.col("var").alias("anc"), F.lit(0).alias("depth")), "ancestors")]
    while not levels[-1].isEmpty():
        if len(levels) > max_rounds:
            raise NotConverged(f"ancestors are not complete after {max_rounds} rounds")
        above = levels[-1].join(edge, "anc").select("var", F.col("parent").alias("anc"), F.lit(len(levels)).alias("depth"))
        levels.append(durable(above, "ancestors"))
    return _all(levels)


def choose(candidates: DataFrame, key: list[str], *order) -> DataFrame:
    """One candidate a key: the first by a total order."""
    return candidates.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def remove_vertices(links: DataFrame, gone: DataFrame, algebra: DataFrame) -> DataFrame:
    """Links (src, nature, dst) without the vertices ``gone`` (var), whose own links are composed first.

    One step through a vertex that goes; nulls in links compose with nothing, repeated links count once.
    """
    into = links.join(gone.select(F.col("var").alias("dst")), "dst", "left_semi")
    made = compose(into, links, algebra)
    every = links.select("src", F.col("nature").cast("int").alias("nature"), "dst").unionByName(made.select("src", F.col("nature").cast("int").alias("nature"), "dst")).distinct()
    return every.join(gone.select(F.col("var").alias("src")), "src", "left_anti").join(gone.select(F.col("var").alias("dst")), "dst", "left_anti").select("src", "nature", "dst")


def nearest_above(elements: DataFrame, overrides: DataFrame, values: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(m, value): the value (anc, value) of the nearest element at or above each m over (sub, sup).

    Of equally near values the smallest counts; an element with a value looks no further; elements
    without any are left out.
    """
    open_ = durable(elements.select("m", F.col("m").alias("anc")).distinct(), "open")
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        if open_.isEmpty():
            return _all(found) if found else elements.select("m").limit(0).withColumn("value", F.lit(None).cast(values.schema["value"].dataType))
        hit = durable(open_.join(values, "anc").groupBy("m").agg(F.min("value").alias("value")), "nearest")
        found.append(hit)
        further = open_.join(hit, "m", "left_anti").join(overrides, F.col("anc") == F.col("sub")).select("m", F.col("sup").alias("anc")).distinct()
        open_ = durable(further, "open")
    raise NotConverged(f"overrides are not at their end after {max_rounds} rounds")


def lift_elements(links: DataFrame, elements: DataFrame, modification: DataFrame, algebra: DataFrame, up: int, down: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Links (src, nature, dst) with elements (var, whole) at local indices replaced by their wholes.

    First the target is lifted, whole by whole, then the source; each step composes with ``up`` (an
    element is in its whole) or ``down``, its reverse. What composes to nothing, links a whole to
    itself or has, once lifted, just one end among ``modification`` (var) goes. Repeated links count once.
    """
    found = links.select("src", F.col("nature").cast("int").alias("nature"), "dst", F.lit(False).alias("lifted")).distinct()
    whole = elements.select("var", "whole").distinct()
    after = algebra.where(F.col("s") == up).select(F.col("r").alias("nature"), "t")
    before = algebra.where(F.col("r") == down).select(F.col("s").alias("nature"), "t")
    for end, table in (("dst", after), ("src", before)):
        open_, done = durable(found, "lift"), []
        while not open_.isEmpty():
            if len(done) > max_rounds:
                raise NotConverged(f"elements are not lifted after {max_rounds} rounds")
            done.append(durable(open_.join(whole.select(F.col("var").alias(end)), end, "left_anti").select("src", "nature", "dst", "lifted"), "lifted"))
            moved = open_.join(whole, F.col(end) == F.col("var")).join(F.broadcast(table), "nature").withColumn(end, F.col("whole"))
            open_ = durable(moved.select("src", F.col("t").alias("nature"), "dst", F.lit(True).alias("lifted")).distinct(), "lift")
        found = _all(done) if done else open_
    marks = lambda end: modification.select(F.col("var").alias(end), F.lit(True).alias(end + "_mod")).distinct()
    both = found.join(marks("src"), "src", "left").join(marks("dst"), "dst", "left")
    return both.where("src <> dst and (not lifted or src_mod <=> dst_mod)").select("src", "nature", "dst").distinct()
