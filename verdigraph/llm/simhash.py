"""SimHash near-duplicates with bit-sliced comparison inside pigeonhole buckets.

Fingerprints at most ``RADIUS`` = 2 bits apart agree on at least two of four 16-bit blocks, so each
distinct fingerprint goes to six buckets (one a pair of blocks) and is compared, bit-sliced, with the
others of a bucket. A bucket above ``BUCKET`` members is split without loss: the free bits are cut in
three parts, at least one of which two near fingerprints share, and its members go to three smaller
buckets each, until no more than 2**11 different fingerprints can be in one. Buckets emit a forest,
never all their pairs; connected components run as joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators import components
from verdigraph.runtime import discard, durable, width

from . import bitslice
from .common import batch, documents, map_batches, texts

SEED = 42
RADIUS = 2
BUCKET = 2048
#: Fingerprints that small buckets are packed to before one bit-sliced comparison.
PACK = 512


def shingle_hashes(text: str, words_each: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``words_each`` lower-cased words, repeats included (A-Z only)."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    starts = [0, *(e + 1 for e in ends[: len(words) - words_each])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words_each - 1 :])], "<u8")


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: each bit set in over half of them; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "i8")
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.add.reduce(np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype="u4")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """(doc_id long, fp long): the 64-bit SimHash of every whole text, as a signed long.

    Reads ``doc_id`` and ``text``. No words (null, empty, blank) give zero.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fold(shingle_hashes(t, words_each)) for t in b.column("text").to_pylist()], "<u8")
            yield batch(schema, b.column("doc_id"), pa.array(prints.view("<i8")))

    return map_batches(texts(docs), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_masks() -> tuple[list[int], list[tuple[int, int]]]:
    """The six first masks, and (mask, finer mask) of every split a too large bucket can take."""
    blocks = [0xFFFF << 16 * k for k in range(4)]
    first = [a | b for a, b in combinations(blocks, 2)]
    finer, todo = [], list(first)
    while todo:
        mask = todo.pop()
        free = [b for b in range(64) if not mask >> b & 1]
        if len(free) > 11:
            for part in np.array_split(free, 3):
                child = mask | sum(1 << int(b) for b in part)
                finer.append((mask, child))
                todo.append(child)
    return first, sorted(set(finer))


def bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """(u, v) forests of near fingerprints from (bucket long, node long, fp binary) rows.

    Rows are dealt by bucket and sorted; small buckets are packed together (a link across buckets is
    as good as one within). Callers bound the rows of one bucket.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(nodes: list[int], prints: list[bytes]):
        own, at = np.unique(np.array(nodes, "<i8"), return_index=True)
        words = np.frombuffer(b"".join([prints[k] for k in at]), "<u8").reshape(len(own), -1)
        label = bitslice.forest(len(own), bitslice.near_pairs(words, radius))
        moved = np.flatnonzero(label != np.arange(len(own)))
        return batch(schema, pa.array(own[moved]), pa.array(own[label[moved]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        prints: list[bytes] = []
        start, held = 0, None  # where the last, perhaps unfinished, bucket begins
        for b in batches:
            for bucket, node, fp in zip(b.column("bucket").to_pylist(), b.column("node").to_pylist(), b.column("fp").to_pylist()):
                if bucket != held:
                    if len(nodes) >= PACK:
                        yield compare(nodes, prints)
                        nodes, prints = [], []
                    start, held = len(nodes), bucket
                nodes.append(node)
                prints.append(fp)
        if nodes:
            yield compare(nodes, prints)

    dealt = members.repartition(width(members.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, run, "u long, v long")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) at most RADIUS bits apart.

    A written table. A bucket that can't be split any more holds at most 2**11 fingerprints and is
    compared whatever their number.
    """
    spark = nodes.sparkSession
    first, finer = split_masks()
    children = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in finer], "mask long, child long")
    members = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in first))).alias("mask"))
    found: list[DataFrame] = []
    while True:
        members = members.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # The table of splits has a few hundred rows whatever the data.
        can_split = F.broadcast(children.select("mask", F.lit(True).alias("open")).distinct())
        placed = durable(members.join(counts, "bucket").join(can_split, "mask", "left").withColumn("large", F.col("open").isNotNull() & (F.col("n") > BUCKET)), "buckets")
        small = placed.where("not large")
        found.append(durable(bucket_links(small.select("bucket", F.col("fp").alias("node"), F.expr("unhex(lpad(hex(fp), 16, '0'))").alias("fp")), RADIUS), "links"))
        large = placed.where("large")
        if large.isEmpty():
            break
        # A fingerprint comes to the same finer bucket on several ways.
        members = durable(large.join(F.broadcast(children), "mask").select("fp", F.col("child").alias("mask")).distinct(), "members")
        found.append(members)
        discard(placed)
    discard(placed)
    links = [x for x in found if "u" in x.columns]
    out = durable(reduce(DataFrame.unionByName, links), "links")
    for x in found:
        discard(x)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id long): the smallest doc_id reachable over near links.

    Reads ``doc_id`` and ``text``. Texts without words share fingerprint zero and are linked like
    any others. A null doc_id is never a component's id unless the component has no other. Repeated
    rows stay repeated. Links are kept between distinct fingerprints only, so copies cost nothing.
    """
    prints = durable(fingerprints(docs), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = near_links(nodes.select("fp"))
    found = components.roots(links)
    discard(links)
    root = found.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = durable(prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"), "near-duplicates")
    for x in (prints, nodes, found):
        discard(x)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
