"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import bound_batches, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (long) and the text with null as empty, whatever else ``docs`` holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Hands what a worker has freed back to the system; a worker that idles keeps the rest until the session ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def tidied(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over a task's batches, and ``give_back`` as the task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def id_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text (crc 0)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def portions(b: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of about ``most`` bytes of ``column``, one row at least."""
    sizes = pa.compute.binary_length(b.column(column)).to_pylist()
    start = held = 0
    for at, n in enumerate(sizes):
        if at > start and held + (n or 0) > most:
            yield b.slice(start, at - start)
            start, held = at, 0
        held += n or 0
    if sizes:
        yield b.slice(start)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema)], schema=schema)
