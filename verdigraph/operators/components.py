"""Connected components of a link table, entirely as joins and aggregates.

Alternates the large-star and small-star steps: links are re-pointed to the smallest neighbour until
every component is a star around its smallest node. Each step is a min-aggregate per node and a join
back, so a hub's links are spread over tasks by the adaptive skew join. Every round is a written
table; only two numbers a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.runtime import discard, durable


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = _least(large)
    small = large.join(least, "u")
    out = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for all nodes but the smallest.

    ``links`` has long columns u and v; loops and repeated links are ignored; none give none.
    """
    current = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(current)
    while before[0]:
        following = durable(_round(current), "links")
        discard(current)
        after = _state(following)
        current = following
        if after == before:
            break
        before = after
    return current
