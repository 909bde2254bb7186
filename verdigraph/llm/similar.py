"""Near-duplicate texts: SimHash candidates compared bit-sliced, then an exact shingle-prefix search.

Texts count as near if the Jaccard similarity of their sets of WORDS-word shingles is SIMILARITY or
more. Every link is decided by the sets themselves. Three things look for links:

1. SimHash. ROUNDS rounds of TABLES tables, keyed by sampled bits of a 128-bit SimHash; within a key a
   bit-sliced comparison keeps pairs at most RADIUS bits apart. A round proposes to each text its
   nearest text of another component, so it checks one link a text at most, and merges components.
2. Nearest by prefix. With shingles in one total order, rare ones first, two sets of similarity
   SIMILARITY or more share a shingle among the first n - ceil(SIMILARITY n) + 1 of each. Again each
   text gets the nearest of the texts of other components that such shingles allow.
3. All by prefix. Every pair that is still in different components, shares a prefix shingle and can
   reach SIMILARITY by sizes and places is checked: first, where its rows meet, by a parity sketch,
   whose distance never exceeds the sets' difference, then by a longer one, then by the sets. This
   leaves no near pair to chance, so the groups are exact up to collisions of 64-bit hashes.

Texts are packed in chunks once; requests for a text's shingles travel to its chunk, texts never move.
Table keys with over HOT members are cut in pieces by chance (the prefix search makes up for that);
prefix shingles with over GRID members are compared in a grid of blocks, all against all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators import components
from verdigraph.runtime import discard, durable, width

from . import bitslice
from .chunks import Chunks, bodies, expand, squeeze
from .common import batch, map_batches, tidied
from .simhash import fold

WORDS, SIMILARITY = 5, 0.8
BITS, RADIUS = 128, 34
ROUNDS, TABLES, LEAST_KEY_BITS, MOST_KEY_BITS = 2, 8, 16, 48
CHUNK_BYTES = 3 << 20
#: Fingerprints compared in one block, members of a table key that stay together, members of a prefix
#: shingle that one task compares, and links of one text that one task checks.
BLOCK, HOT, GRID, RAYS = 2048, 4096, 4096, 1024
#: Slots that documents are counted in by their shingles, only to order shingles by rarity.
SLOTS, SLOT_PARTS = 1 << 18, 64
#: Members of a shingle that are compared by shifted columns; more are compared in blocks.
FEW = 16
#: Sorted rows that are compared at a time, and pairs whose sketches are.
ROWS = 1 << 16
#: Bits of the parity sketches that travel with prefix rows; those of the texts grow with the text.
TIP_BITS = 1024
#: Ids to drop that are sent to every executor; more are joined.
SENT_IDS = 1_000_000

#: Order in which every table samples bits, by a fixed rule.
POSITIONS = np.stack([np.random.default_rng(t).permutation(BITS)[:MOST_KEY_BITS] for t in range(ROUNDS * TABLES)])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_id(words: list[bytes]) -> int:
    """Names a sequence of lower-cased words; 0 without words."""
    return (xxhash.xxh64_intdigest(b" ".join(words), 7) >> 1) | 1 if words else 0


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words (of all words where they are fewer)."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n if words else 0, len(words) < WORDS and len(words), "<u8")
    for k in range(min(WORDS, len(words))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[k : k + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of hashes in two signed halves; the second uses a remix of each hash."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return tuple(np.array([fold(shingles), fold(mixed ^ (mixed >> np.uint64(28)))], "<u8").view("<i8").tolist())


def parity(shingles: np.ndarray, most: int = 1 << 62) -> bytes:
    """One bit a slot, set if an odd number of shingles falls in it; two slots a shingle up to ``most``."""
    size = min(most, 1 << max(6, (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles >> np.uint64(8) & np.uint64(size - 1)).astype("i8"), minlength=size) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Never above the number of shingles that only one of two sets has."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def not_too_far(rows: Rows, pairs):
    """Those ``pairs`` of rows whose short sketches (column tip) don't differ more than similar sets can."""
    length = np.array([len(x) for x in rows.tip.tolist()])
    place, planes = np.zeros(len(length), "i8"), {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        place[at] = np.arange(len(at))
        planes[n] = np.frombuffer(b"".join(rows.tip[at].tolist()), "<u8").reshape(len(at), -1)

    def folded(n: int, to: int, at: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce(planes[n][place[at]].reshape(len(at), n // to, -1), axis=1)

    for i, j in pairs:
        keep = np.zeros(len(i), bool)
        kinds = length[i] << 32 | length[j]
        for kind in np.unique(kinds).tolist():
            a, b = kind >> 32, kind & 0xFFFFFFFF
            of_kind = np.flatnonzero(kinds == kind)
            for k in range(0, len(of_kind), ROWS):
                at = of_kind[k : k + ROWS]
                apart = np.bitwise_count(folded(a, min(a, b), i[at]) ^ folded(b, min(a, b), j[at])).sum(axis=1, dtype="i8")
                keep[at] = apart <= most_apart(rows.size[i[at]], rows.size[j[at]])
        yield i[keep], j[keep]


def most_apart(m, n):
    """Shingles that only one of two similar sets of sizes m and n may have."""
    return (1 - SIMILARITY) / (1 + SIMILARITY) * (m + n) + 1e-6


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= SIMILARITY * (len(p) + len(q) - both) - 1e-9


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype("i8") & (SLOTS - 1)


SKETCH = "doc_id long, chunk long, at long, node long, a long, b long, size long, tip binary, odd binary"


def sketches(chunks: Chunks) -> DataFrame:
    """A row a text as in SKETCH, and for each chunk one with no ``at`` whose ``odd`` counts its slots.

    ``node`` names the text's sequence of lower-cased words. Texts without words have node 0 and no
    fingerprint (a, b); they are copies of each other.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "chunk", "at", "node", "a", "b", "size")] + [("tip", pa.binary()), ("odd", pa.binary())])

    def sketch(chunk: dict) -> Iterator[tuple]:
        total = np.zeros(SLOTS, "<u4")
        for at, (doc, body) in enumerate(zip(chunk["ids"], bodies(chunk))):
            words = words_of(body)
            if not words:
                yield doc, chunk["chunk"], at, 0, None, None, 0, None, None
                continue
            shingles = shingle_set(words)
            total += np.bincount(slots(shingles), minlength=SLOTS).astype("<u4") if len(shingles) > 4096 else 0
            if len(shingles) <= 4096:
                np.add.at(total, slots(shingles), 1)
            yield doc, chunk["chunk"], at, node_id(words), *fingerprint(shingles), len(shingles), parity(shingles, TIP_BITS), parity(shingles)
        yield None, chunk["chunk"], None, None, None, None, None, None, squeeze(total)

    return chunks.map(sketch, SKETCH, schema)


def rarity(counted: DataFrame) -> np.ndarray:
    """Documents by slot of their shingles: a fixed number of counters, whatever the input."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, "<u8")
        for b in batches:
            for blob in b.column("odd").to_pylist():
                total += expand(blob)
        if total.any():
            yield batch(schema, np.arange(SLOT_PARTS), [squeeze(x) for x in total.reshape(SLOT_PARTS, -1)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + expand(counts)
        yield batch(schema, list(sums), [x.tobytes() for x in sums.values()])

    parts = map_batches(counted, partly, "part int, counts binary")
    out = np.zeros((SLOT_PARTS, SLOTS // SLOT_PARTS), "<u8")
    for part, counts in map_batches(parts.repartition(min(SLOT_PARTS, width(counted.sparkSession)), "part"), tidied(add), "part int, counts binary").collect():
        out[part] = np.frombuffer(counts, "<u8")
    return out.ravel()


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rare ones first, of which a set as similar as SIMILARITY has one in its own prefix."""
    ordered = shingles[np.lexsort((shingles, counts[slots(shingles)]))]
    return ordered[: len(ordered) - math.ceil(SIMILARITY * len(ordered) - 1e-9) + 1]


class Rows:
    """Columns of rows as arrays; ``prints`` has the fingerprints as rows of 64-bit words."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.__dict__ |= columns
        if "a" in columns:
            self.prints = np.ascontiguousarray(np.stack([self.a, self.b], axis=1)).view("<u8")


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[Rows]:
    """Whole keys of rows sorted by key, about ROWS rows at a time."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append({c: np.asarray(b.column(c)) for c in b.schema.names})
        if sum(len(x[key]) for x in held) >= ROWS and held[0][key][0] != held[-1][key][-1]:
            rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            cut = int(np.flatnonzero(rows[key] == rows[key][-1])[0])
            yield Rows({c: x[:cut] for c, x in rows.items()})
            held = [{c: x[cut:] for c, x in rows.items()}]
    if held:
        yield Rows({c: np.concatenate([x[c] for x in held]) for c in held[0]})


def sizes_allow(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A similarity is at most the smaller size over the larger."""
    return np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9


def nearest(rows: Rows, pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, bits apart): for each node of a pair, the nearest partner whose label is smaller."""
    best: dict[str, np.ndarray] = {c: np.zeros(0, "i8") for c in "uvd"}
    for i, j in pairs:
        i, j = np.where(rows.label[i] > rows.label[j], i, j), np.where(rows.label[i] > rows.label[j], j, i)
        apart = rows.label[i] != rows.label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            continue
        u = np.concatenate([best["u"], rows.node[i]])
        v = np.concatenate([best["v"], rows.node[j]])
        d = np.concatenate([best["d"], np.bitwise_count(rows.prints[i] ^ rows.prints[j]).sum(axis=1).astype("i8")])
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        new = np.concatenate([[True], u[1:] != u[:-1]])
        best = {"u": u[new], "v": v[new], "d": d[new]}
    return best["u"], best["v"], best["d"]


PROPOSED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.int64())])


def proposals(near: DataFrame) -> DataFrame:
    """Of (u, v, d) rows the nearest v of each u."""
    return near.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select("u", "best.v")


def keyed(labelled: DataFrame, tables: range, key_bits: int) -> DataFrame:
    """(bucket, node, label, size, a, b) of every node with a fingerprint and every table."""
    names = ("bucket", "node", "label", "size", "a", "b")
    schema = pa.schema([(c, pa.int64()) for c in names])
    weights = 1 << np.arange(key_bits, dtype="i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows({c: np.asarray(b.column(c)) for c in names[1:]})
            bits = np.unpackbits(rows.prints.view("u1"), axis=1, bitorder="little")
            for t in tables:
                yield batch(schema, bits[:, POSITIONS[t, :key_bits]].astype("i8") @ weights + (t << MOST_KEY_BITS), *(getattr(rows, c) for c in names[1:]))

    return map_batches(labelled.select(*names[1:]), run, ", ".join(f"{c} long" for c in names))


def simhash_round(labelled: DataFrame, tables: range, key_bits: int) -> DataFrame:
    """(u, v): for each node the nearest of another label that one of the tables shows.

    The members of one key that a task compares are at most HOT or so: more are cut by chance.
    """
    members = keyed(labelled, tables, key_bits)
    hot = durable(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot")
    if (n_hot := hot.count()):
        piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HOT))
        members = members.join(F.broadcast(hot) if n_hot <= SENT_IDS else hot, "bucket", "left").withColumn("bucket", F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", piece))).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "bucket"):
            start = np.flatnonzero(np.concatenate([[True], rows.bucket[1:] != rows.bucket[:-1]]))
            length = np.diff(start, append=len(rows.bucket))
            # Small buckets are compared together; a link across buckets is as good as one within.
            packs, held = [], []
            for s, n in zip(start[length > 1].tolist(), length[length > 1].tolist()):
                if held and held[-1][1] - held[0][0] + n > BLOCK // 4:
                    packs.append(held)
                    held = []
                held.append((s, s + n))
            packs += [held] if held else []
            for pack in packs:
                at = np.concatenate([np.arange(s, e) for s, e in pack])
                for k in range(0, len(at), BLOCK):
                    yield batch(PROPOSED, *nearest(rows, bits_near(rows, at[k : k + BLOCK])))

    dealt = members.repartition(width(labelled.sparkSession), "bucket").sortWithinPartitions("bucket", F.xxhash64("node", "bucket"))
    out = durable(proposals(map_batches(dealt, tidied(run), "u long, v long, d long")), "proposals")
    discard(hot)
    return out


def bits_near(rows: Rows, at: np.ndarray):
    """Pairs of the rows ``at`` that are near by their bits and may be by their sizes."""
    for i, j in bitslice.near_pairs(rows.prints[at], RADIUS):
        fits = sizes_allow(rows.size[at], i, j)
        yield at[i[fits]], at[j[fits]]


def asked(chunk: dict, requests: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    """(request, shingles of the text at its ``at``); a text is read once for all its requests."""
    requests.sort(key=lambda r: r["at"])
    text = dict.fromkeys(r["at"] for r in requests)
    if text:
        for at, body in enumerate(bodies(chunk)):
            if at in text:
                text[at] = body
    held, shingles = -1, np.zeros(0, "<u8")
    for r in requests:
        if r["at"] != held:
            held, shingles = r["at"], shingle_set(words_of(text[r["at"]]))
        yield r, shingles


def checked(chunks: Chunks, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts are similar, by their sets of shingles.

    The set of each u goes to its v, which is there once for RAYS of them.
    """
    spread = F.ceil(F.col("rays") / RAYS)
    hubs = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("rays"))
    place = nodes.select("node", "chunk", "at")
    centres = hubs.select("v", F.explode(F.sequence(F.lit(0), spread.cast("int") - 1)).alias("piece")).select(F.col("v").alias("node"), "v", "piece")
    rays = pairs.join(hubs, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), spread).cast("int").alias("piece"))
    wanted = centres.unionByName(rays).join(place, "node")
    schema = pa.schema([("v", pa.int64()), ("piece", pa.int32()), ("node", pa.int64()), ("shingles", pa.binary())])

    def send(chunk: dict, requests: list[dict]) -> Iterator[tuple]:
        return ((r["v"], r["piece"], r["node"], shingles.tobytes()) for r, shingles in asked(chunk, requests))

    sets = chunks.answer(wanted, send, "v long, piece int, node long, shingles binary", schema)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, "<u8")
        for b in batches:
            found: list[tuple[int, int]] = []
            for v, piece, node, blob in zip(*(b.column(c).to_pylist() for c in ("v", "piece", "node", "shingles"))):
                shingles = np.frombuffer(blob, "<u8")
                if node == v:
                    centre, own = (v, piece), shingles
                elif centre == (v, piece) and similar(own, shingles):
                    found.append((node, v))
            yield batch(out, *(zip(*found) if found else ([], [])))

    dealt = sets.repartition(width(pairs.sparkSession), "v", "piece").sortWithinPartitions("v", "piece", F.col("node") != F.col("v"))
    return durable(map_batches(dealt, tidied(near), "u long, v long"), "near")


def prefix_rows(chunks: Chunks, nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, node, place): the prefix shingles that more than one node has.

    Shingles in slots that far more than the usual number of documents fall in are shared in any
    case, so their rows are spread over tasks.
    """
    names = ("key", "node", "place", "piece")
    schema = pa.schema([(c, pa.int64()) for c in names])
    common = HOT + 8 * int(counts.mean())

    def send(chunk: dict, requests: list[dict]) -> pa.Table:
        found = [(r["node"], prefix(shingles, counts)) for r, shingles in asked(chunk, requests)]
        lengths = [len(own) for _, own in found]
        keys = np.concatenate([np.zeros(0, "<u8"), *(own for _, own in found)])
        node = np.repeat(np.array([n for n, _ in found], "i8"), lengths)
        place = np.concatenate([np.zeros(0, "i8"), *map(np.arange, lengths)]).astype("i8")
        piece = np.where(counts[slots(keys)] > common, 1 + node % 997, 0)
        return pa.table([pa.array(c) for c in (keys.view("<i8"), node, place, piece)], schema=schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "key"):
            again = rows.key[1:] == rows.key[:-1]
            keep = rows.piece > 0
            keep[1:] |= again
            keep[:-1] |= again
            yield batch(schema, *(getattr(rows, c)[keep] for c in names))

    rows = chunks.answer(nodes.where("size > 0").select("chunk", "at", "node"), send, ", ".join(f"{c} long" for c in names), schema)
    dealt = rows.repartition(width(chunks.spark), "key", "piece").sortWithinPartitions("key")
    return durable(map_batches(dealt, tidied(shared), ", ".join(f"{c} long" for c in names)).drop("piece"), "prefixes")


def prefix_pairs(rows: Rows):
    """Pairs of one key (sorted) and different labels that may be similar.

    At the first shingle two ordered sets share, their places bound what else they can share; at
    later ones the bound may drop a pair, which the first has kept then. In a grid (``few`` marks the
    rows of one side) few are compared with the others only.
    """
    key, label = rows.key, rows.label
    left = rows.size - rows.place
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(start, append=len(key))
    run = np.repeat(np.arange(len(start)), length)

    def fits(i, j):
        return (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= SIMILARITY / (1 + SIMILARITY) * (rows.size[i] + rows.size[j]) - 1e-6)

    gridded = hasattr(rows, "few")
    small = np.flatnonzero((length > 1)[run] & (length <= FEW)[run]) if not gridded else np.zeros(0, "i8")
    for shift in range(1, FEW):
        i = small[small + shift < len(key)]
        i = i[run[i] == run[i + shift]]
        if not len(i):
            break
        kept = i[fits(i, i + shift)]
        yield kept, kept + shift
    for k in np.flatnonzero(length > (1 if gridded else FEW)):
        members = np.arange(start[k], start[k] + length[k])
        if gridded:
            few, members = members[rows.few[members] > 0], members[rows.few[members] == 0]
        else:
            values, counts = np.unique(label[members], return_counts=True)
            few = members[label[members] != values[counts.argmax()]]
        for a in range(0, len(few), BLOCK // 4):
            for b in range(0, len(members), BLOCK):
                i, j = few[a : a + BLOCK // 4, None], members[None, b : b + BLOCK]
                x, y = np.nonzero(fits(i, j))
                yield i[x, 0], j[0, y]


def grid(ready: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of ``hot`` keys dealt so that all rows outside a key's largest label meet all of the key.

    A task gets GRID rows or so of either side, whatever the size of the key.
    """
    own = ready.join(hot.select("key"), "key", "left_semi")
    labels = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    top = labels.groupBy("key").agg(F.sum("n").alias("n_all"), F.max(F.struct("n", "label")).alias("top"))
    shape = top.select("key", F.col("top.label").alias("largest"), F.ceil(F.col("n_all") / GRID).cast("int").alias("across"), F.ceil((F.col("n_all") - F.col("top.n")) / GRID).cast("int").alias("down")).where("down > 0")
    placed = own.join(shape, "key")
    columns = ready.columns
    cell = lambda few, down, across: placed.where("label <> largest" if few else "true").select(*columns, F.lit(few).cast("long").alias("few"), down.alias("row"), across.alias("col"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    both = cell(1, own_part("down", 1), every("across")).unionByName(cell(0, every("down"), own_part("across", 2)))
    return both.withColumn("key", F.xxhash64("key", "row", "col")).drop("row", "col")


def prefix_search(shared: DataFrame, labelled: DataFrame, only_nearest: bool) -> DataFrame:
    """(u, v): for each node the nearest of another label among all that prefixes allow, or all those."""
    spark = shared.sparkSession
    has = ["a", "b"] if only_nearest else ["tip"]
    ready = shared.join(labelled.select("node", "label", "size", *has), "node").select("key", "node", "label", "size", "place", *has)
    # A key whose nodes are one component has nothing to say.
    mixed = shared.join(labelled.select("node", "label"), "node").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    mixed = durable(mixed, "mixed")
    hot = mixed.where(F.col("n") > GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "key"):
            if only_nearest:
                yield batch(PROPOSED, *nearest(rows, prefix_pairs(rows)))
                continue
            for i, j in not_too_far(rows, prefix_pairs(rows)):
                if len(i):
                    u, v = np.unique(np.stack([np.maximum(rows.node[i], rows.node[j]), np.minimum(rows.node[i], rows.node[j])]), axis=1)
                    yield batch(PROPOSED, u, v, np.zeros(len(u), "i8"))

    def compared(rows: DataFrame) -> DataFrame:
        return map_batches(rows.repartition(width(spark), "key").sortWithinPartitions("key"), tidied(run), "u long, v long, d long")

    found = compared(ready.join(mixed.where(F.col("n") <= GRID).select("key"), "key"))
    if not hot.isEmpty():
        found = found.unionByName(compared(grid(ready, hot)))
    out = durable(proposals(found) if only_nearest else found.select("u", "v").distinct(), "prefix-pairs")
    discard(mixed)
    return out


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` whose parity sketches don't already differ more than similar sets can."""
    side = lambda end, n, odd: nodes.select(F.col("node").alias(end), F.col("size").alias(n), F.col("odd").alias(odd))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = most_apart(np.asarray(b.column("m")), np.asarray(b.column("n")))
            keep = [parity_distance(x, y) <= z for x, y, z in zip(b.column("p").to_pylist(), b.column("q").to_pylist(), most.tolist())]
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield batch(schema, kept.column("u"), kept.column("v"))

    return durable(map_batches(pairs.join(side("u", "m", "p"), "u").join(side("v", "n", "q"), "v"), run, "u long, v long"), "plausible")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over near links, for each id of ``docs``.

    Reads ``doc_id`` and ``text``; null text is empty. Texts with the same lower-cased words are
    copies, those without words too. Rows with a null doc_id take no part. A doc_id on several rows
    with different texts links them. An empty table gives no rows. The result is a written table;
    all others are deleted.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("side"))
    chunks = Chunks(texts, CHUNK_BYTES)
    told = durable(sketches(chunks), "sketches")
    known = told.where("at is not null").select("doc_id", "node")
    nodes = durable(told.where("at is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("chunk", "at", "a", "b", "size", "tip", "odd")).alias("text")).select("node", "first", "text.*"), "nodes")
    links: list[DataFrame] = []
    root = components.roots(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))

    def merge(found: DataFrame) -> None:
        nonlocal root
        links.append(found)
        old, root = root, components.roots(root.unionByName(found))
        discard(old)

    def labelled() -> DataFrame:
        own = nodes.where("size > 0").join(root.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
        return durable(own.select("node", F.coalesce("root", "node").alias("label"), "size", "a", "b", "tip"), "labelled")

    key_bits = min(MOST_KEY_BITS, max(LEAST_KEY_BITS, nodes.count().bit_length()))
    for k in range(ROUNDS):
        now = labelled()
        found = simhash_round(now, range(k * TABLES, (k + 1) * TABLES), key_bits)
        merge(checked(chunks, nodes, found))
        discard(found)
        discard(now)
    counts = rarity(told.where("at is null").select("odd"))
    shared = prefix_rows(chunks, nodes, counts)
    for only_nearest in (True, False):
        now = labelled()
        found = prefix_search(shared, now, only_nearest)
        likely = plausible(found, nodes)
        discard(found)
        discard(now)
        merge(checked(chunks, nodes, likely))
        discard(likely)
    # Ids on several rows tie their texts together.
    tied = known.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("doc_id", "v")
    merge(durable(known.join(tied, "doc_id").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "tied"))
    rooted = nodes.join(root.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = durable(known.join(rooted.join(least, "root").select("node", "component_id"), "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "groups")
    for df in (told, nodes, shared, root, *links):
        discard(df)
    chunks.drop()
    return out


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents whose group has a smaller doc_id.

    Of rows that repeat the kept doc_id all stay; rows with a null doc_id stay.
    """
    groups = similar_groups(docs)
    gone = durable(groups.where("doc_id <> component_id").select("doc_id"), "copies")
    discard(groups)
    dropped = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(dropped, docs["doc_id"] == gone["doc_id"], "left_anti")
