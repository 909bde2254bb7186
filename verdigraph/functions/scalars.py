"""Column functions: statement indices, normalisers, fingerprints, annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a compact source position in an encoded record.
POSITION = r'"\d+-\d+:\d+-\d+"'


def in_scope_of(scope: Column, index: Column) -> Column:
    """Whether statement ``index`` lies in the block that ``scope`` names; the empty scope has all."""
    return (scope == "") | (index == scope) | F.startswith(index, F.concat(scope, F.lit(".")))


def same_level(a: Column, b: Column) -> Column:
    """Whether two statement indices are in one block."""
    block = lambda c: F.regexp_replace(c, r"(^|\.)[^.]*$", "")
    return block(a) == block(b)


def seen_by(statement: Column, index: Column) -> Column:
    """Whether what happens at ``statement`` is visible at ``index``: earlier, in an enclosing block."""
    return (statement < index) & in_scope_of(F.regexp_replace(statement, r"(^|\.)[^.]*$", ""), index)


def without_positions(encoded: Column) -> Column:
    """An encoded record with its source positions blanked, so that moves don't change its hash."""
    return F.regexp_replace(encoded, POSITION, '""')


def fingerprint(parts: Column) -> Column:
    """SHA-256 over a set of strings, whatever their order (an aggregate)."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(parts))).cast("binary"), 256)


def verdict_hash(*columns: Column) -> Column:
    """An order-insensitive hash of rows (an aggregate): two dumps agree if it does."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def annotation(immutable: Column, hc: str = "hc = true") -> Column:
    """The annotation text of an immutability level; none for a mutable or undecided type."""
    return F.when(immutable == 3, "@Immutable").when(immutable == 2, f"@Immutable({hc})").when(immutable == 1, "@FinalFields")


def snake(name: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def is_standard_functional(name: Column, package: Column) -> Column:
    """Whether values of a type (qualified name, package) are functions without content of their own."""
    return F.coalesce((package == "java.util.function") | name.startswith("kotlin.jvm.functions.Function"), F.lit(False))
