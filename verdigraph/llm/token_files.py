"""Token shards: independent zstandard frames with a trailing seek table and per-frame checksums.

File layout (all integers little-endian)::

    data frame 0..k-1   ids of one or more whole documents, 2 or 4 bytes each
    index frame         doc_ids (int64), id counts (int64), null marks (1 byte each)
    seek table          skippable frame: per frame compressed size, decompressed size, XXH64 low 32
                        bits of the decompressed bytes; then frame count, descriptor, magic

The table is the public zstandard seekable format, so any of its readers can open a shard. A data
frame holds about FRAME_BYTES of ids and never part of a document, and a reader decompresses only
the frames with the documents it asks for.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigraph.runtime import durable, fresh_path, width

from . import storage
from .common import batch, documents, map_batches, texts

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 17
SHARD_BYTES = 1 << 27
LEVEL = 3
#: Bytes of one generation of a worker's memo (two are alive at most), bytes that an entry takes besides
#: its key and value, and length from which a word is too rare to be remembered.
MEMO_BYTES, ENTRY_BYTES, LONG = 80 << 20, 170, 64
#: Bytes of rows from which a worker's batch is encoded.
BATCH_BYTES = 12 << 20
#: Stands between words that are encoded in one call; a word that holds it is encoded alone.
MARK = b"\x01"
#: The normalizer steps, and the pattern whose matches are the pre-tokens, of vocabularies whose
#: words can be put together from a lower-case stem and the punctuation after it.
STEM_STEPS = ["NFC", "Replace", "Lowercase"]
STEM_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of Latin-1 letters and then ASCII punctuation without an apostrophe.
STEM = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class ShardWriter:
    """Writes documents' ids to one open stream, frame by frame."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.dtype = sink, {2: "<u2", 4: "<u4"}[id_bytes]
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
        self.pending: list[bytes] = []
        self.waiting = self.written = 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.pack(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.written += len(packed)

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.waiting = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        if self.waiting and self.waiting + len(raw) > FRAME_BYTES:
            self._flush()
        self.pending.append(raw)
        self.waiting += len(raw)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        self._flush()
        nulls = np.array([d is None for d in self.doc_ids], "u1")
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        self._frame(ids.tobytes() + np.array(self.counts, "<i8").tobytes() + nulls.tobytes())
        body = b"".join(struct.pack("<III", *entry) for entry in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG | {"<u2": 2, "<u4": 4}[self.dtype] >> 1 & 3, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


class ShardReader:
    """Random access to a shard; ``frames_read`` counts the data frames decompressed."""

    def __init__(self, source):
        self.source, self.frames_read = source, 0
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKSUM_FLAG:
            raise ValueError("not a token shard: no seek table with checksums at its end")
        self.dtype = {1: "<u2", 2: "<u4"}[descriptor & 3]
        raw = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.packed, self.raw, self.sums = raw[:, 0], raw[:, 1], raw[:, 2]
        self.offset = np.concatenate([[0], np.cumsum(self.packed)])
        index = self._frame(n - 1)
        docs = len(index) // 17
        self.nulls = np.frombuffer(index, "u1", docs, 16 * docs).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.counts = np.frombuffer(index, "<i8", docs, 8 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]) if docs else np.zeros(1, "i8")
        self.frame_start = np.concatenate([[0], np.cumsum(self.raw[:-1])]) // np.dtype(self.dtype).itemsize
        self.frames_read = 0

    def _frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.packed[k]), int(self.offset[k])), max_output_size=int(self.raw[k]))
        if len(data) != self.raw[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not have its checksum")
        self.frames_read += 1
        return data

    def read(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the shard, ids) of the wanted documents, or of all, in file order."""
        held, ids, first = -1, np.zeros(0, self.dtype), 0
        for i in range(len(self.counts)):
            doc = None if self.nulls[i] else int(self.doc_ids[i])
            if wanted is not None and doc not in wanted:
                continue
            start, n = int(self.starts[i]), int(self.counts[i])
            if n:
                k = int(np.searchsorted(self.frame_start, start, "right")) - 1
                if k != held:
                    held, first, ids = k, int(self.frame_start[k]), np.frombuffer(self._frame(k), self.dtype)
            yield doc, start, ids[start - first : start - first + n] if n else ids[:0]


class WordEncoder:
    """Encodes with the ``tokenizers`` library, each distinct white-space-separated word once.

    That is the same as encoding whole texts for tokenizers that drop white space and let no
    pre-token cross it (checked for the vocabulary by a test over whole texts).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.tokenizer.model._resize_cache(0)  # a word comes once, so the library's own memo is of no use
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        first = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.stems = bool(suffix) and steps == STEM_STEPS and first.get("pattern") == {"Regex": STEM_PATTERN}
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, fresh: list[bytes], memo: dict[bytes, bytes]) -> None:
        """Encode distinct words, a few thousand to a call.

        Letters are one pre-token a word, whose last id alone ends a word; between other words stands a
        mark whose id tells them apart.
        """
        plain = [w for w in fresh if MARK not in w] if self.mark is not None else []
        if self.ends is not None:
            alone = lambda w: w.isalpha() or self.stems and w.decode("utf-8").isalpha()
            letters = [w for w in plain if alone(w)]
            plain = [w for w in plain if not alone(w)]
            for part in (letters[k : k + 4096] for k in range(0, len(letters), 4096)):
                ids = self._ids(b" ".join(part))
                stop = 4 * np.flatnonzero(self.ends[ids]) + 4
                if len(stop) != len(part) or stop[-1] != 4 * len(ids):
                    plain += part
                    continue
                raw, at = ids.tobytes(), 0
                for word, end in zip(part, stop.tolist()):
                    memo[word] = raw[at:end]
                    at = end
        for part in (plain[k : k + 4096] for k in range(0, len(plain), 4096)):
            ids = self._ids((b" " + MARK + b" ").join(part))
            cuts = np.flatnonzero(ids == self.mark)
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            for word, a, b in zip(part, starts, ends, strict=True):
                memo[word] = raw[a:b]
        for word in fresh:
            if word not in memo:
                memo[word] = np.array(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as binary; words that are not remembered are learnt."""
        coded = words.dictionary_encode()
        keys = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, {b"": b""}, 0
        memo, old = self.memo, self.old
        missing = [w for w in keys if w not in memo]
        fresh, long = [], []
        for word in missing:
            known = old.get(word)
            if known is not None:
                memo[word] = known
            else:
                (long if len(word) >= LONG else fresh).append(word)
        self._learn(fresh + long, memo)
        self.held += sum(map(len, missing)) + sum(map(len, map(memo.__getitem__, missing))) + ENTRY_BYTES * len(missing)
        ids = pa.array(list(map(memo.__getitem__, keys)), pa.large_binary())
        for word in long:
            self.held -= len(word) + len(memo.pop(word)) + ENTRY_BYTES
        return ids.take(coded.indices)

    def encode(self, texts_: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text. Arrow finds a batch's distinct words and puts their ids together again.

        Where the vocabulary allows it a word is its lower-case stem and the punctuation after it, a
        pre-token each, so that only stems are learnt and remembered.
        """
        split = pc.ascii_split_whitespace(pa.array(texts_, pa.large_string()) if isinstance(texts_, list) else texts_.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        if self.stems:
            cut = pc.extract_regex(words, STEM)
            stem, tail = (pc.struct_field(cut, name) for name in ("stem", "tail"))
            stems, tails = self._known(pc.coalesce(pc.utf8_lower(stem), words)), self._known(pc.fill_null(tail, ""))
            ids = pc.binary_join_element_wise(stems, tails, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        else:
            ids = self._known(words).take(coded.indices)
        _, ends, data = ids.buffers()
        starts = np.frombuffer(ends, "<i8", len(ids) + 1)[np.asarray(split.offsets)] if len(ids) else np.zeros(len(split) + 1, "i8")
        whole = np.frombuffer(data, "<u4", int(starts[-1]) // 4) if starts[-1] else np.zeros(0, "<u4")
        return [whole[a:b] for a, b in itertools.pairwise((starts // 4).tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined until they have ``least`` bytes; the larger they are, the fewer words they share."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending doc_id order.

    Returns the manifest (part, seq, uri, n_docs, n_tokens), itself a written table. Null ids come
    first; rows with equal ids are ordered by text, so the order is total up to equal rows.
    Texts are range-partitioned by id, so a task holds one frame and the current batch only.
    """
    n = width(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard, uri = TaskContext.get().partitionId(), 0, None, ""
        own = encoder(path)
        id_bytes = 2 if max(own.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4")

        def done():
            shard.close()
            return batch(schema, [part], [seq], [uri], [len(shard.counts)], [sum(shard.counts)])

        for b in _gathered(batches, BATCH_BYTES):
            for doc, ids in zip(b.column("doc_id").to_pylist(), own.encode(b.column("text"))):
                if shard is None:
                    uri = storage.attempt_path(folder, f"part-{part:06d}-{seq:04d}", ".tok.zst")
                    shard = ShardWriter(storage.create(uri), id_bytes)
                shard.add(doc, np.concatenate([ids, end]))
                if shard.written >= SHARD_BYTES:
                    yield done()
                    seq, shard = seq + 1, None
        if shard is not None:
            yield done()

    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return durable(map_batches(ordered, run, "part int, seq int, uri string, n_docs long, n_tokens long"), "token-manifest")


def read_shards(manifest: DataFrame, wanted: set[int | None] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the shards, ``start`` counting ids over all shards before.

    ``ids`` is binary, little-endian unsigned 32-bit. With ``wanted`` only the frames of those
    documents are decompressed.
    """
    # One small row a shard: the running sum is over the manifest, never over documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("uri", "base")
    shards = max(1, manifest.count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist()):
                rows, held = [], 0
                with storage.open_random(uri) as source:
                    for doc, start, ids in ShardReader(source).read(wanted):
                        rows.append((doc, base + start, len(ids), ids.astype("<u4").tobytes()))
                        held += len(rows[-1][3])
                        if held > 1 << 22:
                            yield batch(schema, *map(list, zip(*rows)))
                            rows, held = [], 0
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    return map_batches(placed.repartition(shards), run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "tokens"), end_id=1)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
