"""Values of result rows as text: links, and verdicts with their type.

A link is one row with ids at both ends, so there is nothing to refer back to and no row grows with
its method. Encoding is the inverse of decoding; what cannot be decoded raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import algebra

LINK = "link"


def encode_links(links: DataFrame) -> DataFrame:
    """Result rows (elem_id, package, key, value, origin) of links (m, package, src, nature, dst, origin).

    Rows with a null end or nature have no value; equal links stay equal rows.
    """
    symbols = F.create_map(*(F.lit(x) for k, s in enumerate(algebra.NATURES, 1) for x in (k, s)))
    complete = F.col("src").isNotNull() & F.col("dst").isNotNull()
    value = F.when(complete, F.concat(F.col("src").cast("string"), F.lit(" "), symbols[F.col("nature").cast("int")], F.lit(" "), F.col("dst").cast("string")))
    return links.select(F.col("m").alias("elem_id"), "package", F.lit(LINK).alias("key"), value.alias("value"), "origin")


def decode_links(rows: DataFrame) -> DataFrame:
    """Links (m, package, src, nature, dst, origin) of the result rows that hold some; other rows are passed over."""
    ranks = F.create_map(*(F.lit(x) for s, k in algebra.RANK.items() for x in (s, k)))
    part = F.split("value", " ")
    held = rows.where((F.col("key") == LINK) & F.col("value").isNotNull())
    broken = F.raise_error(F.concat(F.lit("no link: "), F.col("value")))
    nature = F.when(F.col("value").rlike(r"^-?\d+ \S+ -?\d+$") & F.coalesce(F.array_contains(F.map_keys(ranks), F.get(part, F.lit(1))), F.lit(False)), ranks[F.get(part, F.lit(1))]).otherwise(broken.cast("int"))
    return held.select(F.col("elem_id").alias("m"), "package", F.get(part, F.lit(0)).try_cast("long").alias("src"), nature.alias("nature"), F.get(part, F.lit(2)).try_cast("long").alias("dst"), "origin")


def encode_value(value: Column, kind: str) -> Column:
    """A verdict as text: ``bool``, ``level`` (int), ``text``, or ``set`` (array of int, sorted); null stays null."""
    if kind == "set":
        return F.when(value.isNotNull(), F.concat_ws(",", F.transform(F.array_sort(F.array_distinct(value)), lambda x: x.cast("string"))))
    return value.cast("string")


def decode_value(text: Column, kind: str) -> Column:
    """The inverse of ``encode_value``; a text of another kind raises."""
    if kind == "set":
        return F.when(text == "", F.array().cast("array<int>")).otherwise(F.split(text, ",").cast("array<int>"))
    return text.cast({"bool": "boolean", "level": "int", "text": "string"}[kind])
