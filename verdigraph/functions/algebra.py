"""The label algebra: natures with rank and reverse, and how two of them compose.

The closure takes the algebra as tables, so another one can be passed instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Symbols by rising rank, the pairs that are each other's reverse, and the composition of
# every first label (rows) with every second one (columns), both by rank; X is nothing.
NATURES = ["∩", "≤", "≥", "≈", "≺", "≻", "~", "⊆", "⊇", "∈?", "∋?", "∈", "∋", "↗", "↖", "≡", "←", "→"]
REVERSES = [("∈", "∋"), ("≺", "≻"), ("⊆", "⊇"), ("≤", "≥"), ("←", "→"), ("↗", "↖"), ("∈?", "∋?")]
COMPOSITION = """
∩ ∩ X X X X ∩ ∩ ∩ X X ∩ ∩ X X ∩ ∩ ∩
X ≤ X X ≤ X X ≤ ∩ X X ≤ X X X ≤ ≤ ≤
∩ ∩ ≥ ∩ ∩ ≥ ∩ ∩ ≥ X X ∩ ≥ X X ≥ ≥ ≥
X ∩ X ≈ ∩ X X ∩ ∩ X X ∩ X X X ≈ ≈ ≈
X ≤ X X ≺ X X ≤ X X X ≤ X X X ≺ ≺ ≺
X ∩ ≥ ∩ ≈ ≻ ∩ ∩ ≥ X X ∩ ≥ X X ≻ X ≻
∩ ∩ X X ∩ X ~ ~ ∩ X X ∩ ∋? X X ~ ~ ~
∩ ≤ ∩ ∩ ≤ X ∩ ⊆ X X X ≤ X X X ⊆ ⊆ ⊆
∩ ∩ ≥ ∩ ∩ ≥ ~ ~ ⊇ X ∋? ∩ ∋ X X ⊇ ⊇ ⊇
X X X X X X X ∈? X ∈? X X X X X ∈? ∈? ∈?
X X X X X X X X X X ∋? X ∋? X X ∋? ∋? ∋?
∩ ≤ X X ≤ X ∈? ∈ X ∈? X ∈ X X X ∈ ∈ ∈
∩ ∩ ≥ ∩ ∩ ≥ ∩ ∩ ≥ X X ~ ∋ X X ∋ ∋ ∋
X X X X X X X X X X X X X ↗ X ↗ X ↗
X X X X X X X X X X X X X X ↖ ↖ X ↖
∩ ≤ ≥ ≈ ≺ ≻ ~ ⊆ ⊇ ∈? ∋? ∈ ∋ ↗ ↖ ≡ ← →
∩ ≤ ≥ ≈ ≺ ≻ ~ ⊆ ⊇ ∈? ∋? ∈ ∋ ↗ ↖ ← ← ≡
∩ ≤ ≥ ≈ X ≻ ~ ⊆ ⊇ ∈? ∋? ∈ ∋ X X → X →
"""

RANK = {s: i for i, s in enumerate(NATURES, 1)}
REVERSE = {s: s for s in NATURES} | dict(REVERSES) | {b: a for a, b in REVERSES}


_ROWS = [line.split() for line in COMPOSITION.split("\n")[1:-1]]


def combine(r: str, s: str) -> str | None:
    """The label of a -> c from a -r-> b -s-> c, or None."""
    found = _ROWS[RANK[r] - 1][RANK[s] - 1]
    return None if found == "X" else found


def entries() -> list[tuple[int, int, int]]:
    """(r, s, t) by rank, of all pairs that compose."""
    return [(RANK[r], RANK[s], RANK[t]) for r in NATURES for s in NATURES if (t := combine(r, s))]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "r int, s int, t int")


def natures(spark: SparkSession) -> DataFrame:
    """(nature, symbol, reverse): the dimension table."""
    return spark.createDataFrame([(RANK[s], s, RANK[REVERSE[s]]) for s in NATURES], "nature int, symbol string, reverse int")
