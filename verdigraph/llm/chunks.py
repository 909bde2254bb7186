"""Texts packed in chunks that tasks can come back to, and compact column blobs.

Some operators ask the whole corpus about every piece of every text and need the answers next to the
text again. They write texts once, packed in compressed chunks, as a table bucketed by chunk: joining
answers to chunks then moves only the answers. A chunk bounds what one task holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.runtime import bound_batches, fresh_path, remove_path, width

from .common import batch, map_batches

SCHEMA = "chunk long, side int, n_bytes long, ids array<long>, lengths binary, body binary"


def squeeze(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes: high bytes of small numbers cost nothing."""
    values = np.ascontiguousarray(values)
    return values.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(values.view("u1").reshape(len(values), -1).T.tobytes() if len(values) else b"")


def expand(blob: bytes) -> np.ndarray:
    dtype = np.dtype(blob[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[3:]), "u1")
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """A sorted uint64 array by its differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype="<u8")


class Chunks:
    """A written table of packed texts; ``table`` reads it, ``drop`` deletes it."""

    def __init__(self, texts: DataFrame, chunk_bytes: int):
        """Packs (doc_id, text, side int) rows; a chunk has one side and at least one document.

        Texts are packed whole, in the order of doc_id within a chunk (null ids first, equal ids by
        text).
        """
        spark = texts.sparkSession
        schema = pa.schema([("chunk", pa.int64()), ("side", pa.int32()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("body", pa.binary())])

        def pack(chunk: int, side: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in docs))
            return batch(schema, [chunk], [side], [sum(len(t) for _, t in docs)], [[i for i, _ in docs]], [squeeze(np.array([len(t) for _, t in docs], "<i8"))], [body])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 24
            held: dict[int, list] = {}
            size: dict[int, int] = {}
            for b in batches:
                for doc, text, side in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("side").to_pylist()):
                    if held.get(side) and size[side] + len(text) > chunk_bytes:
                        yield pack(number, side, held.pop(side))
                        number += 1
                    held.setdefault(side, []).append((doc, text))
                    size[side] = len(text) + (size[side] if len(held[side]) > 1 else 0)
            for side, docs in held.items():
                yield pack(number, side, docs)
                number += 1

        self.spark, self.n = spark, width(spark)
        self.name, self.path = f"verdigraph_chunks_{uuid.uuid4().hex}", fresh_path(spark, "chunks")
        packed = map_batches(texts.select("doc_id", "text", "side"), run, SCHEMA)
        packed.write.bucketBy(self.n, "chunk").option("path", self.path).saveAsTable(self.name)
        total = self.table().agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
        self.n_bytes, self.count = total[0] or 0, total[1]

    def table(self, side: int | None = None) -> DataFrame:
        found = self.spark.table(self.name)
        return found if side is None else found.where(F.col("side") == side)

    def map(self, fn: Callable[[dict], Iterator[tuple]], schema: str, arrow: pa.Schema, side: int | None = None) -> DataFrame:
        """``fn`` (chunk as a dict) gives rows of ``schema`` for every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    rows = list(fn(unpack(b.slice(row, 1).to_pylist()[0])))
                    if rows:
                        yield batch(arrow, *map(list, zip(*rows)))

        bound_batches(self.spark)
        return self.table(side).mapInArrow(run, schema)

    def answer(self, answers: DataFrame, fn: Callable[[dict, list[dict]], Iterator[tuple]], schema: str, arrow: pa.Schema, side: int | None = None) -> DataFrame:
        """``fn`` (chunk, its rows of ``answers``) gives rows of ``schema``, or all of them as one table;
        the chunks don't move."""

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[tuple] = []
            for chunk in left.to_pylist():  # one, or none where answers have no chunk
                rows = fn(unpack(chunk), right.to_pylist())
            if isinstance(rows, pa.Table):
                return rows
            columns = list(zip(*rows)) or [[] for _ in arrow]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        bound_batches(self.spark)
        return self.table(side).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


def unpack(row: dict) -> dict:
    """A chunk row with its body decompressed and ``lengths`` as an array."""
    return row | {"lengths": expand(row["lengths"]), "body": zstandard.ZstdDecompressor().decompress(row["body"])}


def bodies(chunk: dict) -> Iterator[bytes]:
    at = 0
    for n in chunk["lengths"].tolist():
        yield chunk["body"][at : at + n]
        at += n
