"""Folds over three-valued verdicts and lattices, and the rules that write verdicts.

NULL is "undecided" everywhere. Spark's min, max and bool_and skip NULLs, so each fold says what an
undecided member does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUTABLE, FINAL_FIELDS, IMMUTABLE_HC, IMMUTABLE = range(4)
DEPENDENT, INDEPENDENT_HC, INDEPENDENT = range(3)


def any_null(c: Column) -> Column:
    return F.coalesce(F.max(c.isNull()), F.lit(False))


def all_or_false(c: Column) -> Column:
    """TRUE if every member is TRUE; an undecided one counts as FALSE; TRUE of none."""
    return F.coalesce(F.min(F.coalesce(c, F.lit(False))), F.lit(True))


def all_or_wait(c: Column) -> Column:
    """FALSE if one member is; else NULL if one is undecided; else TRUE."""
    return F.when(F.min(c) == F.lit(False), F.lit(False)).when(any_null(c), F.lit(None).cast("boolean")).otherwise(F.lit(True))


def least_or_wait(c: Column) -> Column:
    """The least member, or NULL while one is undecided."""
    return F.when(any_null(c), F.lit(None)).otherwise(F.min(c))


def least_or_bottom(c: Column, bottom: int) -> Column:
    """The least member; NULL while one is undecided, unless the bottom is there already."""
    return F.when(F.min(c) == bottom, F.lit(bottom)).otherwise(least_or_wait(c))


def worst_link(mutable: Column, hc: Column) -> Column:
    """Independence of a value from its links' content: a mutable one decides, then any undecided."""
    return (
        F.when(F.max(F.coalesce(mutable, F.lit(False))), F.lit(DEPENDENT))
        .when(any_null(mutable), F.lit(None).cast("int"))
        .when(F.max(F.coalesce(hc, F.lit(False))), F.lit(INDEPENDENT_HC))
        .otherwise(F.lit(INDEPENDENT))
    )


def upsert(old: DataFrame, new: DataFrame, allowed: Column) -> DataFrame:
    """(elem_id, key, value, refused): write-once properties with controlled overwrite.

    Both have (elem_id, key, value). A new value fills an absent one; over another value it wins only
    where ``allowed`` (of columns ``before`` and ``after``), else the old stays and ``refused`` is set.
    """
    both = old.select("elem_id", "key", F.col("value").alias("before")).join(new.select("elem_id", "key", F.col("value").alias("after")), ["elem_id", "key"], "full_outer")
    change = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after"))
    value = F.when(F.col("after").isNull() | (change & ~F.coalesce(allowed, F.lit(False))), F.col("before")).otherwise(F.col("after"))
    return both.select("elem_id", "key", value.alias("value"), (change & ~F.coalesce(allowed, F.lit(False))).alias("refused"))


def cutover(reached: Column, contracted: Column, immutable: Column, old: Column, tainted: Column) -> Column:
    """The verdict after reachability: one ordered rule list; tainted and contracted verdicts stay."""
    return (
        F.when(reached & contracted, old)
        .when(reached & immutable, old)
        .when(reached & old.isNull(), F.lit(False))
        .when(reached & old, F.lit(False))
        .when(~reached & old.isNull() & (immutable | ~tainted), F.lit(True))
        .when(~reached & (old == F.lit(False)) & ~tainted, F.lit(True))
        .otherwise(old)
    )


def immutability(assignable: Column, super_least: Column, super_null: Column, independent: Column, rules: Column, hc: Column, break_cycles: bool = False) -> Column:
    """A type's immutability level by the ordered rules; NULL while a rule still waits."""
    return (
        F.when(assignable, F.lit(MUTABLE))
        .when(super_least == MUTABLE, F.lit(MUTABLE))
        .when(independent == DEPENDENT, F.when(super_null, F.lit(None).cast("int")).otherwise(F.lit(FINAL_FIELDS)))
        .when(super_least == FINAL_FIELDS, F.lit(FINAL_FIELDS))
        .when(rules == F.lit(False), F.lit(FINAL_FIELDS))
        .when(rules.isNull(), F.lit(FINAL_FIELDS) if break_cycles else F.lit(None).cast("int"))
        .when(super_null | independent.isNull(), F.lit(None).cast("int"))
        .when(hc | (super_least == IMMUTABLE_HC) | (independent == INDEPENDENT_HC), F.lit(IMMUTABLE_HC))
        .otherwise(F.lit(IMMUTABLE))
    )


def null_outcome(reference: Column, verdict: Column) -> Column:
    """How a nullness verdict compares with a reference state."""
    return (
        F.when(reference == "UNSPECIFIED", "UNSCORED")
        .when(verdict == "UNSPECIFIED", "UNDECIDED")
        .when(reference == verdict, "AGREE")
        .when(reference == "NULLABLE", "UNSAFE")
        .otherwise("NOISE")
    )
