"""Language-model scoring by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | context) mixes the relative frequencies of all orders and a uniform part; where a context was
never counted, the other parts share its weight, so probabilities sum to one. The mixture weights
depend on how often the contexts were seen (bucketed by powers of two) and are learned by expectation
maximisation on held-out counts: a tenth of the training documents is left out of the counts that the
weights are fitted with, and counted in afterwards.

Counting is distributed by n-gram. Each chunk of texts sends its distinct n-grams, sorted, in one blob
to each range of the 64-bit n-gram keys; the range's task adds the counts up and sends each chunk's
totals back in the same order. So what moves is distinct n-grams a chunk, a frequent n-gram counts
once a chunk, and no table of counts is ever sent to all executors.

Keys are 64-bit hashes. Two of n distinct n-grams share a key with probability about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import bound_batches, discard, durable, width

from .chunks import Chunks, bodies, expand, expand_sorted, squeeze, squeeze_sorted
from .common import documents, id_remainder, texts

ORDER = 2
CHUNK_BYTES = 6 << 20
#: Bytes of text a counting task answers for, at all orders.
RANGE_BYTES = 12 << 20
ROUNDS = 12
#: Added to each expected count, so that every weight stays above zero.
PRIOR = 0.5

#: Sides of the corpus: scored only, counted for the weights' fit, left out of that.
HELD_OUT, FIT, LEFT_OUT = 0, 1, 2

END = xxhash.xxh64_intdigest(b"\n", 0)
BEGIN = 0x9E3779B97F4A7C15


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context ^ (context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(chunk: dict, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys of the n-grams ending at each token, for n = 1 to ``order``; tokens in each document)."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for body in bodies(chunk):
        words = body.lower().split()
        hashes += map(digest, words)
        hashes.append(END)
        sizes.append(len(words) + 1)
    first = np.array(hashes, "<u8")
    sizes_ = np.array(sizes, "i8")
    keys = [first]
    heads = np.cumsum(sizes_) - sizes_
    context = first
    for n in range(2, order + 1):
        before = np.roll(context, 1)
        before[heads] = np.uint64(BEGIN * n & 0xFFFFFFFFFFFFFFFF)
        context = _mix(before, first)
        keys.append(context)
    return keys, sizes_


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(keys), "i8")
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def range_bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the key space begins in sorted keys, and the end."""
    top = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype("i8")
    return np.searchsorted(top, np.arange(ranges + 1))


COUNTS = "chunk long, n int, part int, fit binary, left_out binary, n_distinct long, n_tokens long"
COUNTS_ARROW = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("fit", pa.binary()), ("left_out", pa.binary()), ("n_distinct", pa.int64()), ("n_tokens", pa.int64())])


def count(chunks: Chunks, order: int) -> DataFrame:
    """For each chunk, order and key range: the corpus counts of the chunk's distinct n-grams."""
    ranges = max(width(chunks.spark), -(-chunks.n_bytes // RANGE_BYTES))
    sent = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("side", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])

    def send(chunk: dict) -> Iterator[tuple]:
        for n, keys in enumerate(keys_of(chunk, order)[0], 1):
            own, place = distinct(keys)
            times = np.bincount(place, minlength=len(own)).astype("<u4")
            bounds = range_bounds(own, ranges)
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[part], bounds[part + 1]
                yield n, part, chunk["chunk"], chunk["side"], squeeze_sorted(own[a:b]), squeeze(times[a:b])

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [expand_sorted(r["keys"]) for r in rows]
        times = np.concatenate([expand(r["times"]) for r in rows]).astype("i8")
        side = np.repeat([r["side"] for r in rows], [len(k) for k in keys])
        own, place = distinct(np.concatenate(keys))
        totals = [np.bincount(place, np.where(side == s, times, 0), len(own)).astype("<u4" if times.sum() < 1 << 32 else "<u8") for s in (FIT, LEFT_OUT)]
        known = (totals[0] + totals[1]) > 0
        out, at = [], 0
        for r, k in zip(rows, keys):
            where = place[at : at + len(k)]
            at += len(k)
            out.append((r["chunk"], r["n"], r["part"], squeeze(totals[0][where]), squeeze(totals[1][where]), None, None))
        out[0] = (*out[0][:5], int(known.sum()), int(totals[0].sum() + totals[1].sum()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), COUNTS_ARROW)], schema=COUNTS_ARROW)

    blobs = chunks.map(send, "n int, part int, chunk long, side int, keys binary, times binary", sent)
    bound_batches(chunks.spark)
    dealt = blobs.repartition(max(width(chunks.spark), min(ranges * order, 10_000)), "n", "part")
    return durable(dealt.groupBy("n", "part").applyInArrow(add, COUNTS), "ngram-counts")


def gathered(chunk: dict, answers: list[dict], order: int):
    """Keys' corpus counts at each token: per order (fit, left out), and tokens in each document."""
    keys, sizes = keys_of(chunk, order)
    out = []
    for n, k in enumerate(keys, 1):
        place = distinct(k)[1]
        own = sorted((a for a in answers if a["n"] == n), key=lambda a: a["part"])
        out.append(tuple(np.concatenate([expand(a[c]) for a in own]).astype("i8")[place] for c in ("fit", "left_out")))
    return out, sizes


def contexts(counts: list[np.ndarray], sizes: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """How often the context of each token was counted, for orders from 2 on."""
    heads = np.cumsum(sizes) - sizes
    out = []
    for c in counts[:-1]:
        seen = np.roll(c, 1)
        seen[heads] = n_docs
        out.append(seen)
    return out


def bucket(seen: list[np.ndarray], size: int) -> np.ndarray:
    """One number for the power-of-two frequencies of all contexts."""
    out = np.zeros(size, "i8")
    for c in seen:
        out = out * 64 + np.frexp(c.astype(float))[1]
    return out


def learn(chunks: Chunks, counts: DataFrame, order: int, n_fit: int, docs_fit: int, vocabulary: int) -> dict[int, list[float]]:
    """Mixture weights (uniform first) by bucket; key -1 has those of all buckets together."""
    names = [f"c{n}" for n in range(1, order + 1)] + [f"d{n}" for n in range(2, order + 1)]
    arrow = pa.schema([(c, pa.int64()) for c in ("bucket", *names, "times")])

    def tally(chunk: dict, answers: list[dict]) -> list[tuple]:
        counted, sizes = gathered(chunk, answers, order)
        fit = [c[0] for c in counted]
        seen = contexts(fit, sizes, docs_fit)
        # Where an order's count is zero its context's count no longer matters.
        rows = np.stack([bucket(seen, len(fit[0])), *fit, *(np.where(c > 0, s, 0) for c, s in zip(fit[1:], seen))])
        found, times = np.unique(rows, axis=1, return_counts=True)
        return list(map(tuple, np.vstack([found, times]).T.tolist()))

    mine = counts.join(F.broadcast(chunks.table(LEFT_OUT).select("chunk")), "chunk", "left_semi") if chunks.count <= 100_000 else counts.join(chunks.table(LEFT_OUT).select("chunk"), "chunk", "left_semi")
    stats = chunks.answer(mine, tally, ", ".join(f"{c} long" for c in ("bucket", *names, "times")), arrow, LEFT_OUT)
    stats = durable(stats.groupBy("bucket", *names).agg(F.sum("times").alias("times")), "em-counts")
    parts = [F.lit(1.0 / (vocabulary + 1)), F.col("c1") / F.lit(float(max(n_fit, 1)))] + [F.when(F.col(f"d{n}") > 0, F.col(f"c{n}") / F.col(f"d{n}")).otherwise(0.0) for n in range(2, order + 1)]
    stats = stats.select("bucket", "times", *(p.alias(f"p{k}") for k, p in enumerate(parts)))
    buckets = [r[0] for r in stats.select("bucket").distinct().collect()]  # at most 64 a context order
    weights = {b: [1.0 / (order + 1)] * (order + 1) for b in buckets}
    totals = dict.fromkeys([-1], [1.0 / (order + 1)] * (order + 1))
    for _ in range(ROUNDS if buckets else 0):
        now = chunks.spark.createDataFrame([(b, *w) for b, w in weights.items()], "bucket long, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        joint = [F.col(f"w{k}") * F.col(f"p{k}") for k in range(order + 1)]
        mixed = sum(joint[1:], joint[0])
        got = stats.join(F.broadcast(now), "bucket").groupBy("bucket").agg(*(F.sum(F.col("times") * j / mixed).alias(f"e{k}") for k, j in enumerate(joint))).collect()
        for r in got:
            e = [r[f"e{k}"] + PRIOR for k in range(order + 1)]
            weights[r["bucket"]] = [x / sum(e) for x in e]
        e = [sum(r[f"e{k}"] for r in got) + PRIOR for k in range(order + 1)]
        totals[-1] = [x / sum(e) for x in e]
    discard(stats)
    return weights | totals


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every whole text under a model learned from the rows with id remainder mod 10 over 0.

    Reads ``doc_id`` and ``text``. Tokens are A-Z-lower-cased words and one end a document. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10; see the module).
    Null and empty texts are just an end; a null id counts as remainder 0; repeated rows all count and
    are all scored. Without training rows counts are zero and scores those of the uniform part.
    """
    side = F.when(F.col("remainder") == 0, HELD_OUT).when(F.col("remainder") == 1, LEFT_OUT).otherwise(FIT)
    ready = texts(docs).withColumn("remainder", id_remainder(F.col("doc_id"), 10)).select("doc_id", "text", side.cast("int").alias("side"))
    chunks = Chunks(ready, CHUNK_BYTES)
    counts = count(chunks, order)
    v, n = counts.where("n = 1").agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    sides = {r["side"]: r["n"] for r in chunks.table().groupBy("side").agg(F.sum(F.size("ids")).alias("n")).collect()}
    docs_fit, docs_train = sides.get(FIT, 0), sides.get(FIT, 0) + sides.get(LEFT_OUT, 0)

    def fit_tokens(chunk: dict) -> list[tuple]:
        return [(sum(len(b.split()) + 1 for b in bodies(chunk)),)]

    n_left = chunks.map(fit_tokens, "n long", pa.schema([("n", pa.int64())]), LEFT_OUT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = learn(chunks, counts, order, n - n_left, docs_fit, v)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rate(chunk: dict, answers: list[dict]) -> list[tuple]:
        counted, sizes = gathered(chunk, answers, order)
        train = [a + b for a, b in counted]
        seen = contexts(train, sizes, docs_train)
        buckets, place = np.unique(bucket(seen, len(train[0])), return_inverse=True)
        w = np.array([weights.get(b, weights[-1]) for b in buckets.tolist()])[place]
        p, mass = w[:, 0] / (v + 1), w[:, 0].copy()
        for k, (c, s) in enumerate(zip(train, [np.full(len(w), n), *seen]), 1):
            p += w[:, k] * np.divide(c, s, out=np.zeros(len(c)), where=s > 0)
            mass += np.where(s > 0, w[:, k], 0)
        p /= mass  # an order whose context was never counted has no estimate, so no share
        base = np.log10((train[0] + 0.1) / (n + 0.1 * (v + 1)))
        heads = np.cumsum(sizes) - sizes
        columns = (sizes, np.add.reduceat((train[0] > 0).astype("i8"), heads), np.add.reduceat(base, heads), np.add.reduceat(np.log10(p), heads))
        held_out = chunk["side"] == HELD_OUT
        return [(i, held_out, t, k, n, b, s) for i, t, k, b, s in zip(chunk["ids"], *(c.tolist() for c in columns))]

    out = durable(chunks.answer(counts, rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", arrow), "lm-scores")
    chunks.drop()
    discard(counts)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
