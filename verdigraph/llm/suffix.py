"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a LENGTH-byte string that also starts earlier covers it. Every such string (window)
holds an anchor: the leftmost of its smallest hashed K-grams. Equal windows have equal anchors at
equal places, so windows are dealt to tasks by their anchor's K-gram, which cuts the space of all
suffixes in independent slices. Three steps:

1. Texts are packed in chunks. A chunk reduces to runs of windows with one anchor; each run sends the
   hash of its K-gram and of all bytes its windows cover. Runs whose K-gram is nowhere else are done:
   hashes only say what is unique. Equal runs of one chunk are compared there, byte by byte.
2. All other runs send their bytes to their K-gram's slice.
3. A slice takes these in corpus order, batch by batch. Each batch gets a suffix array (cut at LENGTH
   bytes), is scanned against the sorted levels of the family for matches of the full length, and
   joins it as a new level; equal-sized levels merge, so a suffix is re-sorted a logarithmic number of
   times. Only windows that a scan found equal, byte by byte, to earlier ones go.

No slice takes a hot K-gram whole. Above SPLIT runs, only the first run of each kind (equal hashes)
goes to the K-gram's slice; the others of a kind meet their first in slices of FOLLOWERS runs. Above
SPLIT kinds, these firsts are cut finer, by the LENGTH - SPREAD + 1 bytes that windows with nearly the
same distance to the anchor share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import bound_batches, discard, durable, width

from .chunks import Chunks, bodies, expand, expand_sorted, squeeze, squeeze_sorted
from .common import documents, texts

LENGTH = 100
K = 32
CHUNK_BYTES = 3 << 20
#: Bytes of text whose runs one task compares, and bytes of text that there is one slice for.
RANGE_BYTES = 48 << 20
SLICE_BYTES = 1 << 20
SPLIT, FOLLOWERS, SPREAD = 1_000, 16_384, 8
#: Windows in one batch of a slice.
BATCH = 100_000

_POSITION_BITS = 24
#: Bytes of a chunk whose hashes are held at a time.
PIECE = 1 << 19
_TABLE = np.frombuffer(hashlib.shake_128(b"byte hashes").digest(256 * 8), "<u8")


def _twice(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings of 2 * step bytes from those of step bytes."""
    x = h[:-step] * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x += h[step:]
    x *= np.uint64(0xCA5A826395121157)
    x ^= x >> np.uint64(29)
    return x


def _anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest of every ``span`` consecutive hashes, compared by their high bits."""
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    low = (grams & ~mask) | np.arange(len(grams), dtype="<u8")
    step = 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return (np.minimum(low[: len(low) - (span - step)], low[span - step :]) & mask).astype("i4")


def pieces(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, document numbers, lengths) of stretches of a body, of about PIECE bytes at most.

    A longer document comes in overlapping parts, so that every window is in exactly one stretch; a
    run that is cut there is two runs, which changes no result.
    """
    docs: list[int] = []
    sizes: list[int] = []
    start = at = 0
    for doc, n in enumerate(lengths.tolist()):
        if docs and at - start + n > PIECE:
            yield start, np.array(docs), np.array(sizes)
            docs, sizes, start = [], [], at
        if n > PIECE:
            for a in range(0, n - LENGTH + 1, PIECE):
                yield at + a, np.array([doc]), np.array([min(n - a, PIECE + LENGTH - 1)])
            start = at + n
        else:
            docs.append(doc)
            sizes.append(n)
        at += n
    if docs:
        yield start, np.array(docs), np.array(sizes)


FIELDS = ("first", "last", "anchor", "doc", "key", "whole")


def _runs(body: bytes, docs: np.ndarray, lengths: np.ndarray, offset: int) -> tuple[np.ndarray, ...] | None:
    """The FIELDS of the runs in one stretch."""
    each = np.maximum(lengths - LENGTH + 1, 0)
    total = int(each.sum())
    if not total:
        return None
    h = _TABLE[np.frombuffer(body, "u1")]
    step = 1
    while step < K:
        h = _twice(h, step)
        step *= 2
    h64 = _twice(h, K)
    anchor = _anchors(h, LENGTH - K + 1)  # by window start
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths), dtype="i4"), each)
    window = np.arange(total, dtype="i4") + np.repeat((starts - (np.cumsum(each) - each)).astype("i4"), each)
    of = anchor[window]
    new = np.empty(total, bool)
    new[0] = True
    new[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first = window[at].astype("i8")
    last = window[np.concatenate([at[1:], [total]]) - 1].astype("i8")
    own = of[at].astype("i8")
    stop = last + LENGTH
    whole = (stop - first).astype("<u8") << np.uint64(32) | (own - first).astype("<u8")
    for place in (first, (first + stop - 64) // 2, stop - 64):
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + h64[place]
    whole ^= whole >> np.uint64(28)
    # Anchors have small hashes; mixed once more, their keys fill all ranges evenly.
    key = h[own] * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    return first + offset, last + offset, own + offset, docs[doc[at]], key * np.uint64(0xD6E8FEB86659FD93), whole


class Runs:
    """Runs of windows with one anchor in the concatenated documents of a chunk, in order.

    Arrays by run: ``first`` and ``last`` window start, ``anchor``, ``doc``, and the hashes ``key``
    (of the anchor's K-gram) and ``whole`` (of all bytes covered, and the anchor's place in them).
    """

    def __init__(self, body: bytes, lengths: np.ndarray):
        found = [r for at, docs, sizes in pieces(lengths) if (r := _runs(body[at : at + int(sizes.sum())], docs, sizes, at))]
        for k, field in enumerate(FIELDS):
            empty = np.zeros(0, "<u8" if field in ("key", "whole") else "i8")
            setattr(self, field, np.concatenate([r[k] for r in found]) if found else empty)


class Family:
    """Sorted suffix levels of geometric sizes over one slice; ``add`` takes batches in corpus order."""

    def __init__(self):
        self.levels: list[np.ndarray] = []  # sorted distinct suffixes, disjoint, sizes falling

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Marks each suffix (fixed-width bytes, in order) that an earlier one equals in full."""
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ordered = suffixes[order]
        repeat = np.zeros(len(ordered), bool)
        repeat[1:] = ordered[1:] == ordered[:-1]
        group = np.cumsum(~repeat) - 1
        fresh = ordered[~repeat]
        known = np.zeros(len(fresh), bool)
        for level in self.levels:  # merge scan: both sides are sorted
            place = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            known |= level[place] == fresh
        out = np.empty(len(suffixes), bool)
        out[order] = repeat | known[group]
        self._insert(fresh[~known])
        return out

    def _insert(self, level: np.ndarray) -> None:
        if not len(level):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(np.sort(np.concatenate([a, b]), kind="stable"))


def suffixes_of(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all LENGTH-byte windows of the contents as fixed-width bytes, their number in each)."""
    flat = np.frombuffer(b"".join(contents), "u1")
    sizes = np.array([len(c) for c in contents])
    each = sizes - LENGTH + 1
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.cumsum(sizes) - sizes, each)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[at]).view(f"S{LENGTH}").ravel(), each


#: What step 1 says about a run: nothing equals it; ask with its bytes; ask, finely cut; ask its first.
CLEAN, ASK, ASK_FINE, FOLLOW = 0, 1, 2, 3


def local_first(runs: Runs, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(runs that are the first of their kind in the chunk, sorted by key; runs that equal an earlier one)."""
    order = np.lexsort((np.arange(len(runs.key)), runs.whole, runs.key))
    key, whole = runs.key[order], runs.whole[order]
    same = np.zeros(len(order), bool)
    same[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
    first = order[~same][np.cumsum(~same) - 1]
    content = lambda r: body[runs.first[r] : runs.last[r] + LENGTH]
    later = [r for r, f in zip(order[same].tolist(), first[same].tolist()) if content(r) == content(f)]
    return order[~same], np.array(later, "i8")


def _each(new: np.ndarray) -> np.ndarray:
    """For every row the number of rows of its group; ``new`` marks the groups' first rows."""
    sizes = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
    return np.repeat(sizes, sizes)


def judge(key: np.ndarray, whole: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 1's verdicts for runs given with their place in the corpus, and the slices a hot kind takes."""
    order = np.lexsort((place, whole, key))
    k, w = key[order], whole[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_kind = new_key.copy()
    new_kind[1:] |= w[1:] != w[:-1]
    runs, equal = _each(new_key), _each(new_kind)
    group = np.cumsum(new_key) - 1
    kinds = np.bincount(group, new_kind, minlength=1)[group] if len(k) else np.zeros(0)
    hot = runs > SPLIT
    leader = np.where(kinds > SPLIT, ASK_FINE, ASK)
    verdict = np.where(runs == 1, CLEAN, np.where(~hot, ASK, np.where(new_kind, leader, FOLLOW)))
    pieces = np.where(hot & (equal > 1), -(-equal // FOLLOWERS), 0)
    out, cut = np.empty(len(k), "u1"), np.empty(len(k), "<u4")
    out[order], cut[order] = verdict, pieces
    return out, cut


def _place(doc_ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Ids as sortable numbers with null before all."""
    return np.where(nulls, np.iinfo("i8").min, doc_ids)


def _ties(chunk: dict) -> np.ndarray:
    """A number for the text of each document, to order rows of one id by."""
    return np.array([xxhash.xxh64_intdigest(b) for b in bodies(chunk)], "<u8")


def repeated(chunks: Chunks, tied: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(chunk, spans): by chunk, starts of windows that also start earlier; tables to delete.

    ``spans`` holds the first and the last starts of stretches of such windows. ``tied`` says that ids
    stand on several rows; these are ordered by a hash of their texts.
    """
    spark = chunks.spark
    ranges = max(width(spark), -(-chunks.n_bytes // RANGE_BYTES))
    sent = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("wholes", pa.binary()), ("docs", pa.binary()), ("base", pa.int64()), ("offsets", pa.binary()), ("ties", pa.binary())])

    def bounds(keys: np.ndarray) -> np.ndarray:
        top = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype("i8")
        return np.searchsorted(top, np.arange(ranges + 1))

    def send(chunk: dict) -> Iterator[tuple]:
        runs = Runs(chunk["body"], chunk["lengths"])
        first, _ = local_first(runs, chunk["body"])
        if not len(first):
            return
        ties = _ties(chunk)[runs.doc[first]] if tied else None
        ids = _place(np.array([i or 0 for i in chunk["ids"]], "i8"), np.array([i is None for i in chunk["ids"]]))
        keys, docs = runs.key[first], ids[runs.doc[first]]
        # Rows with one id and one text are told apart by the chunk's number and their place in it.
        offsets = runs.first[first]
        cut = bounds(keys)
        for part in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[part], cut[part + 1]
            base = int(docs[a:b].min())
            yield part, chunk["chunk"], int(b - a), squeeze_sorted(keys[a:b]), squeeze(runs.whole[first[a:b]]), squeeze((docs[a:b] - base).astype("<u8")), base, squeeze(offsets[a:b].astype("<u4")), squeeze(ties[a:b]) if tied else None

    verdicts = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("verdicts", pa.binary()), ("pieces", pa.binary())])

    def decide(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = np.concatenate([expand_sorted(r["keys"]) for r in rows])
        wholes = np.concatenate([expand(r["wholes"]) for r in rows])
        docs = np.concatenate([expand(r["docs"]).astype("i8") + r["base"] for r in rows])
        offsets = np.concatenate([expand(r["offsets"]) for r in rows])
        sizes = [r["n"] for r in rows]
        chunk = np.repeat([r["chunk"] for r in rows], sizes)
        ties = np.concatenate([expand(r["ties"]) for r in rows]) if tied else np.zeros(len(docs), "<u8")
        order = np.lexsort((offsets, chunk, ties, docs))
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        found, pieces = (np.split(x, np.cumsum(sizes)[:-1]) for x in judge(keys, wholes, place))
        return pa.table([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([squeeze(v) for v in found], pa.binary()), pa.array([squeeze(v) for v in pieces], pa.binary())], schema=verdicts)

    blobs = chunks.map(send, "part int, chunk long, n long, keys binary, wholes binary, docs binary, base long, offsets binary, ties binary", sent)
    bound_batches(spark)
    told = durable(blobs.repartition(max(width(spark), min(ranges, 10_000)), "part").groupBy("part").applyInArrow(decide, "chunk long, part int, verdicts binary, pieces binary"), "run-verdicts")

    asked = pa.schema([("chunk", pa.int64()), ("spans", pa.binary()), ("slice", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int64()), ("content", pa.binary())])

    def ask(chunk: dict, answers: list[dict]) -> Iterator[tuple]:
        runs, body, number = Runs(chunk["body"], chunk["lengths"]), chunk["body"], chunk["chunk"]
        first, later = local_first(runs, body)
        if len(later):
            yield number, squeeze(np.stack([runs.first[later], runs.last[later]]).astype("<u4").ravel()), number, 0, 0, 0, None
        if not len(first):
            return
        answers = sorted(answers, key=lambda a: a["part"])
        found, pieces = (np.concatenate([expand(a[c]) for a in answers]) for c in ("verdicts", "pieces"))
        ids = _place(np.array([i or 0 for i in chunk["ids"]], "i8"), np.array([i is None for i in chunk["ids"]]))
        ties = (_ties(chunk) >> np.uint64(1)).astype("i8") if tied else np.zeros(len(ids), "i8")
        asks = found != CLEAN
        for r, verdict, n in zip(first[asks].tolist(), found[asks].tolist(), pieces[asks].tolist()):
            a, lo, hi, of = int(runs.anchor[r]), int(runs.first[r]), int(runs.last[r]), int(runs.doc[r])
            doc, tie, key = int(ids[of]), int(ties[of]), int(runs.key[r])
            if verdict == ASK:
                yield number, None, key - (1 << 63), doc, tie, lo, body[lo : hi + LENGTH]
            elif verdict == ASK_FINE:
                for band in range((a - hi) // SPREAD, (a - lo) // SPREAD + 1):
                    s, e = max(lo, a - SPREAD * band - SPREAD + 1), min(hi, a - SPREAD * band)
                    core = body[a - SPREAD * band : a - SPREAD * band - SPREAD + 1 + LENGTH]
                    mixed = xxhash.xxh64_intdigest(core, band) ^ key
                    yield number, None, mixed - (1 << 63), doc, tie, s, body[s : e + LENGTH]
            # The first of a hot kind goes wherever others of it do.
            for piece in [number % n] if verdict == FOLLOW else range(n):
                mixed = xxhash.xxh64_intdigest(int(runs.whole[r]).to_bytes(8, "little"), piece) ^ key
                yield number, None, mixed - (1 << 63), doc, tie, lo, body[lo : hi + LENGTH]

    bound_batches(spark)
    wanted = chunks.answer(told, ask, "chunk long, spans binary, slice long, doc long, tie long, first long, content binary", asked)
    slices = max(width(spark), -(-chunks.n_bytes // SLICE_BYTES))
    known = pa.schema([("chunk", pa.int64()), ("spans", pa.binary())])

    def search(group: pa.Table) -> pa.Table:
        compared = group.filter(pa.compute.is_null(group.column("content")))
        group = group.filter(pa.compute.is_valid(group.column("content"))).sort_by([("doc", "ascending"), ("tie", "ascending"), ("chunk", "ascending"), ("first", "ascending")])
        family, found = Family(), [np.zeros((2, 0), "i8")]
        contents, chunk, first = group.column("content").to_pylist(), np.asarray(group.column("chunk")), np.asarray(group.column("first"))
        at = 0
        while at < len(contents):
            stop, held = at, 0
            while stop < len(contents) and (stop == at or held + len(contents[stop]) - LENGTH + 1 <= BATCH):
                held += len(contents[stop]) - LENGTH + 1
                stop += 1
            suffixes, each = suffixes_of(contents[at:stop])
            marks = family.add(suffixes)
            start = np.arange(len(marks)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[at:stop], each)
            found.append(np.stack([np.repeat(chunk[at:stop], each)[marks], start[marks]]))
            at = stop
        rows = stretches(np.concatenate(found, axis=1)) + list(zip(*(compared.column(c).to_pylist() for c in ("chunk", "spans"))))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[], []], known)], schema=known)

    sliced = wanted.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(slices)))
    found = sliced.repartition(min(slices, 10_000), "part").groupBy("part").applyInArrow(search, "chunk long, spans binary")
    return found, [told]


def stretches(found: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk, spans) from the chunks (row 0) and starts (row 1) of repeated windows."""
    chunk, start = found[:, np.lexsort((found[1], found[0]))]
    new = np.ones(len(chunk), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, of = start[at], start[np.concatenate([at[1:], [len(start)]]) - 1] if len(at) else start, chunk[at]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    return [(int(of[a]), squeeze(np.stack([first[a:b], last[a:b]]).astype("<u4").ravel())) for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(of)])]


def covered(n: int, marks: list[dict]) -> np.ndarray:
    """Which of a body's ``n`` bytes repeated windows cover, from a chunk's marks."""
    change = np.zeros(n + LENGTH + 1, "i4")
    for m in marks:
        first, last = expand(m["spans"]).astype("i8").reshape(2, -1)
        np.add.at(change, first, 1)
        np.add.at(change, last + LENGTH, -1)
    return np.cumsum(change[:n]) > 0


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(docs: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """REMOVED rows, not yet computed, and what deletes the tables that they are computed from."""
    rows = texts(docs)
    # One row a repeated id is enough to know that there are ties.
    tied = bool(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))
    chunks = Chunks(rows.withColumn("side", F.lit(0)), CHUNK_BYTES)
    marks, written = repeated(chunks, tied)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(chunk: dict, marks: list[dict]) -> list[tuple]:
        gone, out, at = covered(len(chunk["body"]), marks), [], 0
        for doc, body in zip(chunk["ids"], bodies(chunk)):
            own = gone[at : at + len(body)]
            at += len(body)
            starts = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            kept = np.frombuffer(body, "u1")[~own].tobytes() if starts else body
            out.append((doc, len(body), int(own.sum()), starts, kept))
        return out

    def delete() -> None:
        for df in written:
            discard(df)
        chunks.drop()

    return chunks.answer(marks, cut, REMOVED, arrow), delete


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every whole text, as UTF-8 bytes.

    Reads ``doc_id`` and ``text``. Null and empty texts keep nothing of nothing. Rows with a null id
    come before all others; rows with equal ids are ordered by a hash of their texts, so results do not
    depend on how the input is dealt. Strings are judged on the input, not on what is left of it. The
    result is a written table; all others are deleted.
    """
    out, delete = _removed(docs)
    kept = durable(out, "kept")
    delete()
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, delete = _removed(documents(spark, sf_dir))
    told = durable(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "removed")
    delete()
    return told
