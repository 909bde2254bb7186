"""WARC archives: written with payload de-duplication, read in parallel by boundary chains.

Reading cuts files in blocks. Each task reports, for every place in its block that looks like the
start of a record, where the record after it would start and where the chain first leaves the block.
Pointer jumping over these candidate-to-successor offsets, from offset 0 of each file, keeps only
the true entry of each block, so a record's magic inside a payload is never taken for a record. The
records are then read from each block's entry on.

Archives are plain, or gzip with a member for each record (``packed``).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import durable, fresh_path, table

from . import storage
from .common import batch, map_batches

VERSION = b"WARC/1.1"
MAGIC = {True: b"\x1f\x8b\x08", False: b"WARC/1."}
ARCHIVE_BYTES = 1 << 26
BLOCK_BYTES = 1 << 22
LEVEL = 4
#: Bytes read at a time beyond a block, and the most a record's header may take.
CHUNK, HEADER_BYTES = 1 << 16, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(headers: list[tuple[str, object]], block: bytes, packed: bool) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", len(block))])
    raw = VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"
    if not packed:
        return raw
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, packed: bool) -> bytes:
    """A response record, or, if ``refers_to`` names another page of equal payload, a revisit."""
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", len(payload))]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record([*headers, ("Content-Type", "application/http; msgtype=response")], http + (b"" if revisit else payload), packed)


def write_archives(pages: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest (uri, size, n).

    Of rows with equal payloads those with the smallest page_id are responses, the others (also those
    with a null id, if there is one that is not) revisit it. Null html is the empty payload; a null
    url leaves its header out. Equal payloads are found by SHA-1 with one pre-aggregated row a digest,
    so a payload that a third of all rows share is only ever joined, never gathered.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    ready = rows.join(shared, "sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    schema = pa.schema([("uri", pa.string()), ("size", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, size, n = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, ref in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    uri = storage.attempt_path(folder, "pages", ".warc.gz" if packed else ".warc")
                    sink, n = storage.create(uri), 0
                    size = sink.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(None)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", packed))
                size += sink.write(page_record(page_id, url, payload, ref, packed))
                n += 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield batch(schema, [uri], [size], [n])
        if sink is not None:
            sink.close()
            yield batch(schema, [uri], [size], [n])

    return durable(map_batches(ready, run, "uri string, size long, n long"), "archive-manifest")


class Archive:
    """One open archive file."""

    def __init__(self, source, size: int, packed: bool):
        self.source, self.size, self.packed = source, size, packed

    def member(self, at: int, whole: bool) -> tuple[bytes, int] | None:
        """(record bytes, offset after it) of what starts at ``at``; None if that is no record.

        Unless ``whole``, the bytes may be just the header: enough to know the successor.
        """
        return self._packed(at, whole) if self.packed else self._plain(at, whole)

    def _packed(self, at: int, whole: bool) -> tuple[bytes, int] | None:
        z, out, head, read = zlib.decompressobj(31), [], b"", at
        while not z.eof:
            data = self.source.read_at(min(CHUNK, self.size - read), read) if read < self.size else b""
            if not data:
                return None
            read += len(data)
            try:
                got = z.decompress(data)
            except zlib.error:
                return None
            if len(head) < 7:
                head += got[:7]
                if not MAGIC[False].startswith(head[:7]):
                    return None
            if whole:
                out.append(got)
        return b"".join(out), read - len(z.unused_data)

    def _plain(self, at: int, whole: bool) -> tuple[bytes, int] | None:
        head, read = b"", at
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if len(head) > HEADER_BYTES or read >= self.size:
                return None
            head += self.source.read_at(min(CHUNK, self.size - read), read)
            read = at + len(head)
        if not head.startswith(MAGIC[False]):
            return None
        length = next((v for k, v in header_lines(head[:stop]) if k == "content-length"), "")
        if not (length.isascii() and length.isdigit()):
            return None
        after = at + stop + 4 + int(length) + 4
        if after > self.size or self.source.read_at(4, after - 4) != b"\r\n\r\n":
            return None
        return (self.source.read_at(after - at, at) if whole else head[: stop + 4]), after

    def candidates(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """(offset, successor) of every place in [lo, hi) where a record could start."""
        magic = MAGIC[self.packed]
        data = self.source.read_at(min(self.size, hi + len(magic) - 1) - lo, lo)
        at = data.find(magic)
        while at >= 0:
            found = self.member(lo + at, whole=False)
            if found:
                yield lo + at, found[1]
            at = data.find(magic, at + 1)


def header_lines(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(header_lines(head))
    return headers, rest[: int(headers["content-length"])]


def exits(chain: list[tuple[int, int]], hi: int) -> list[int]:
    """Where each candidate's chain first leaves its block, by jumping from the last candidate back."""
    out: dict[int, int] = {}
    for at, after in reversed(chain):
        out[at] = after if after >= hi else out.get(after, -1)
    return [out[at] for at, _ in chain]


def block_entries(manifest: DataFrame, packed: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uri, size, entry): the first true record of every block that has one.

    ``manifest`` has (uri, size). Pointer jumping doubles the distance each round, so a file of n
    blocks takes about log2(n) rounds, whatever its number of records.
    """
    spark = manifest.sparkSession
    blocks = manifest.where("size > 0").select("uri", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(block_bytes))).alias("lo"))
    n_blocks = max(1, manifest.agg(F.sum(F.ceil(F.col("size") / block_bytes))).first()[0] or 1)
    schema = pa.schema([("uri", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("successor", pa.int64()), ("jump", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size, lo in zip(*(c.to_pylist() for c in b.columns)):
                hi = min(size, lo + block_bytes)
                with storage.open_random(uri) as source:
                    chain = list(Archive(source, size, packed).candidates(lo, hi))
                yield batch(schema, [uri] * len(chain), [size] * len(chain), [c[0] for c in chain], [c[1] for c in chain], exits(chain, hi))

    found = map_batches(blocks.repartition(min(n_blocks, 4 * spark.sparkContext.defaultParallelism + n_blocks // 8)), run, "uri string, size long, at long, successor long, jump long")
    jumps = durable(found.select("uri", "size", "at", "jump"), "jumps")
    reached = durable(manifest.where("size > 0").select("uri", "size", F.lit(0).cast("long").alias("entry")), "reached")
    count = reached.count()
    while count:
        step = jumps.select("uri", F.col("at").alias("entry"), "jump")
        further = reached.join(step, ["uri", "entry"]).where("jump < size").select("uri", "size", F.col("jump").alias("entry"))
        reached_next = durable(reached.unionByName(further).distinct(), "reached")
        now = reached_next.count()
        if now == count:
            broken = reached_next.join(step, ["uri", "entry"], "left").where("coalesce(jump, -1) < 0")
            if not broken.isEmpty():
                raise ValueError(f"archive broken after offset {broken.first()['entry']} of {broken.first()['uri']}")
            break
        count, reached = now, reached_next
        twice = jumps.select("uri", F.col("at").alias("jump"), F.col("jump").alias("far"))
        jumps = durable(jumps.join(twice, ["uri", "jump"], "left").select("uri", "size", "at", F.coalesce("far", "jump").alias("jump")), "jumps")
    return reached


def read_archives(manifest: DataFrame, packed: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every page record: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    ``payload`` is null for revisits; digest and length are of the full payload. A response whose
    payload doesn't have its digest raises. Files without records give none.
    """
    entries = block_entries(manifest, packed, block_bytes)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size, at in zip(*(c.to_pylist() for c in b.columns)):
                hi, rows = (at // block_bytes + 1) * block_bytes, []
                with storage.open_random(uri) as source:
                    archive = Archive(source, size, packed)
                    while at < min(hi, size):
                        found = archive.member(at, whole=True)
                        if found is None:
                            raise ValueError(f"no record at offset {at} of {uri}")
                        (headers, block), at = parse(found[0]), found[1]
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["warc-payload-digest"].partition(":")[2]
                        if payload is not None and payload_digest(payload) != digest:
                            raise ValueError(f"payload before offset {at} of {uri} does not have its digest")
                        rows.append((number(headers.get("x-page-id")), headers.get("warc-target-uri"), kind, number(headers.get("x-refers-to-page")), payload, int(headers["x-payload-length"]), digest))
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    n = max(1, entries.count())
    return map_batches(entries.select("uri", "size", "entry").repartition(n), run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "archives"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits are twenty bits, so four base-32 characters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(body) AS x FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * g, 5))::BIGINT >> s) & 31)::INT, 1) FOR s IN [15, 10, 5, 0]], '') FOR g IN range(8)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""
