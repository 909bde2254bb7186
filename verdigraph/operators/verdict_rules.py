"""Rules that several queries share: null policies, natures by array dimensions, flow of statements."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import algebra
from verdigraph.operators.fixpoint import MAX_ROUNDS, NotConverged
from verdigraph.runtime import discard, durable


@dataclass(frozen=True)
class Policy:
    """What counts as a null source, and what a declaration gets that no null reaches.

    ``sources`` are the null sources that count; ``in_test`` says whether nulls of test code do.
    """

    name: str
    unreached: str = "NONNULL"
    null_tests: bool = True
    contracts: bool = True
    closed_world: bool = True
    assert_content_writes: bool = False
    call_results: bool = False
    assert_at_declaration: bool = False
    library_callbacks: bool = False
    test_nulls: bool = True
    preconditions_non_null: bool = False
    rejections_nullable: bool = False


#: The presets of the null policies.
NULL_MARKED = Policy("NULL_MARKED")
FLOW_ONLY = replace(NULL_MARKED, name="FLOW_ONLY", null_tests=False)
CAUTIOUS = replace(NULL_MARKED, name="CAUTIOUS", unreached="UNSPECIFIED")
KOTLIN = replace(NULL_MARKED, name="KOTLIN", assert_content_writes=True, call_results=True, assert_at_declaration=True, library_callbacks=True)
PRESETS = (NULL_MARKED, FLOW_ONLY, CAUTIOUS, KOTLIN)


def counted_sources(sources: DataFrame, policy: Policy) -> DataFrame:
    """(node, strict): the null sources (node, source, in_test) that count under a policy.

    A source is strict if it is a null that somebody wrote; contracts of libraries, default values and
    comparisons with null are indirect evidence. Nulls in any column count as no source.
    """
    kept = sources if policy.null_tests else sources.where("source <> 'null test'")
    kept = kept if policy.test_nulls else kept.where("not in_test")
    strict = F.col("source").isin("literal", "argument")
    return kept.where("node is not null and source is not null").groupBy("node").agg(F.max(strict).alias("strict"))


def state(reached: Column, bound: Column, policy: Policy) -> Column:
    """A declaration's null state: a contract first, then what reaches it, then the policy's default."""
    out = F.when(reached, "NULLABLE").otherwise(policy.unreached)
    return F.when(bound, "NONNULL").otherwise(out) if policy.contracts else out


def shallow_nature(arrays: Column, arrays_source: Column, reverse: Column, sharing: str = "⊆") -> Column:
    """The link of a library member without a body, by the array dimensions of both ends (as ranks)."""
    rank = algebra.RANK
    equal = F.when(arrays > 0, rank[sharing]).when(reverse, rank["→"]).otherwise(rank["←"])
    return F.when(arrays == arrays_source, equal).when(arrays < arrays_source, rank["∈"]).otherwise(rank["∋"])


def flow(statements: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(s, falls_through, breaks_out) of statements (s, parent, leaf, is_loop, infinite), bottom-up.

    A leaf returns, breaks or goes on. The children of a statement run in order of ``s``: it falls
    through if all do, and may break out at any child that is reached. A loop takes its breaks in; it
    falls through unless it is infinite and holds no break. Always escaping is neither. A round settles
    one more level, by the children's states alone; a cycle of parents raises NotConverged.
    """
    known = durable(statements.join(statements.select(F.col("parent").alias("s")).distinct(), "s", "left_anti").select("s", (F.col("leaf") == "plain").alias("falls_through"), (F.col("leaf") == "break").alias("breaks_out")), "flow")
    inner = statements.join(statements.where("parent is not null").groupBy(F.col("parent").alias("s")).agg(F.count(F.lit(1)).alias("n")), "s").select("s", "is_loop", "infinite", "n")
    up = statements.where("parent is not null").select("s", "parent")
    total = statements.select("s").distinct().count()
    for _ in range(max_rounds):
        done = known.count()
        if done == total:
            return known
        settled = up.join(known, "s").groupBy(F.col("parent").alias("s")).agg(F.count(F.lit(1)).alias("got"), F.array_sort(F.collect_list(F.struct(up["s"], "falls_through", "breaks_out"))).alias("run"))
        ready = settled.join(inner, "s").where("got = n").join(known.select("s"), "s", "left_anti")
        stop = F.coalesce(F.array_position(F.transform("run", lambda c: c["falls_through"]), False).cast("int"), F.lit(0))
        reached = F.when(stop == 0, F.col("run")).otherwise(F.slice("run", 1, F.greatest(stop, F.lit(1))))
        breaks, falls = F.exists(reached, lambda c: c["breaks_out"]), stop == 0
        new = ready.select("s", F.when(F.col("is_loop"), ~F.col("infinite") | breaks).otherwise(falls).alias("falls_through"), F.when(F.col("is_loop"), False).otherwise(breaks).alias("breaks_out"))
        before, known = known, durable(known.unionByName(new), "flow")
        discard(before)
        if known.count() == done:
            break
    raise NotConverged("statements that hold each other have no flow")
