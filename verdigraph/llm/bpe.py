"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

A pre-token's symbols form a doubly linked list. Every adjacent pair that has a merge goes into a
heap as (rank, position); an entry is stale, and skipped, once either symbol changed. Ties in rank
go left to right. Pieces of text repeat, so each worker keeps a bounded two-generation memo.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, map_batches, portions, texts, tidied

#: Bytes of one generation of a memo (two are alive at most), bytes that an entry takes besides its key
#: and value, and length from which a piece of text is too rare to be remembered.
MEMO_BYTES, ENTRY_BYTES, LONG = 32 << 20, 180, 64
#: Bytes of text encoded at a time by a task with a codec of its own.
PORTION = 1 << 20

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loose_space = re.compile(r" \s|\s ")


def byte_alphabet() -> dict[str, int]:
    """Printable characters that stand for bytes: Latin-1 printables for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Ids of pre-tokens: computes what it lacks and holds two generations of ``size`` bytes.

    Keys may be several pre-tokens long; only single ones are remembered.
    """

    def __init__(self, split, compute, size: int = MEMO_BYTES):
        super().__init__()
        self.split, self.compute, self.size, self.held, self.old = split, compute, size, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            parts = self.split(key)
            if len(parts) > 1:
                return b"".join(map(self.__getitem__, parts))
            value = self.compute(key)
        if len(key) >= LONG:
            return value
        self.held += len(key) + len(value) + ENTRY_BYTES
        if self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Codec:
    """One vocabulary file (``tokenizers`` JSON with a byte-level BPE model)."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        self.rank: dict[int, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.left)
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.strings[i] = content.encode()
        self.special_re = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.split = regex.compile(PATTERN).findall
        self.pieces = Memo(self.split, self.merge, memo_bytes)
        # Ranks of pairs of bytes, in place for the heap; -1 where there is no merge.
        pairs = [self.rank.get(a << 20 | b) for a in self.byte_id for b in self.byte_id]
        self.start = [-1 if r is None else r << 32 for r in pairs]

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        raw = word.encode("utf-8")
        ids = list(map(self.byte_id.__getitem__, raw))
        n, rank, start = len(ids), self.rank, self.start
        heap = [r | i for i, (a, b) in enumerate(zip(raw, raw[1:])) if (r := start[a << 8 | b]) >= 0]
        if heap:
            heapq.heapify(heap)
            following, before = list(range(1, n + 1)), list(range(-1, n - 1))
            left, right, made = self.left, self.right, self.made
            while heap:
                top = heapq.heappop(heap)
                r, i = top >> 32, top & 0xFFFFFFFF
                j = following[i]
                if j >= n or ids[i] != left[r] or ids[j] != right[r]:
                    continue  # stale
                ids[i], ids[j] = made[r], -1
                k = following[i] = following[j]
                if k < n:
                    before[k] = i
                    s = rank.get(ids[i] << 20 | ids[k])
                    if s is not None:
                        heapq.heappush(heap, s << 32 | i)
                h = before[i]
                if h >= 0:
                    s = rank.get(ids[h] << 20 | ids[i])
                    if s is not None:
                        heapq.heappush(heap, s << 32 | h)
            ids = [i for i in ids if i >= 0]
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _loose_space.search(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        # Every space stands between two characters that are no space, so pre-tokens start there.
        first, *rest = text.split(" ")
        if not rest:
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        if not rest[-1]:  # a space at the end is a pre-token of its own
            rest.pop()
            tail = self.pieces[" "]
        else:
            tail = b""
        head = self.pieces[first] if first else b""
        return head + b"".join([self.pieces[" " + p] for p in rest]) + tail

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; special strings become their own ids."""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special_ids[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_all(self, texts_: list[str]) -> list[bytes]:
        """``encode`` of each text; what stands after a space is looked up once a batch, not once a place."""
        odd = lambda t: _loose_space.search(t) or self.special_re is not None and self.special_re.search(t)
        out = [self.encode(t) if odd(t) else None for t in texts_]
        heads = [(i, *t.partition(" ")) for i, t in enumerate(texts_) if out[i] is None]
        split = pc.split_pattern(pa.array([rest if space else None for _, _, space, rest in heads], pa.large_string()), " ")
        coded, pieces = split.flatten().dictionary_encode(), self.pieces
        ids = pa.array([pieces[" " + p] for p in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, "<i8", len(ids) + 1)[np.asarray(split.offsets)].tolist() if len(ids) else [0] * (len(heads) + 1)
        whole = memoryview(data) if len(ids) else memoryview(b"")
        for (i, head, _, _), a, b in zip(heads, ends, ends[1:]):
            out[i] = (pieces[head] if head else b"") + whole[a:b]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: their vocabulary strings one after the other; broken UTF-8 is replaced."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file, read once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def coder(path: str, memo_bytes: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of ``encode_decode`` does with its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path) if memo_bytes is None else Codec(path, memo_bytes)
        for whole in batches:
            for b in [whole] if memo_bytes is None else portions(whole, "text", PORTION):
                ids = own.encode_all(b.column("text").to_pylist())
                yield batch(SCHEMA, b.column("doc_id"), ids, [own.decode(i) for i in ids])

    return run if memo_bytes is None else tidied(run)


def encode_decode(docs: DataFrame, path: str, memo_bytes: int | None = None) -> DataFrame:
    """Ids and decoded text of every whole text: (doc_id long, ids binary, decoded string).

    Reads ``doc_id`` and ``text``. ``ids`` are little-endian unsigned 32-bit integers. Null and empty
    texts have no ids and decode to the empty text; repeated rows give repeated rows; texts of any
    length are encoded whole. One pass without a shuffle: nothing grows with the corpus.

    A worker keeps its codec and memo for the next task. With ``memo_bytes`` a task has its own, with
    generations of that size, takes small portions, and leaves nothing behind in the worker.
    """
    return map_batches(texts(docs), coder(path, memo_bytes), "doc_id long, ids binary, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
