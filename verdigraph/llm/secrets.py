"""Secret scan: an Aho-Corasick keyword pass, regular expressions anchored at hits, then checksums.

One automaton holds every kind's keywords, so most texts never meet a regular expression. A regular
expression is only ever matched at a hit's own position. Kinds with a checksum inside the secret
(CRC-32 in base 62) are reported only if it is right; the base kinds have none and always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, map_batches, texts, tidied

#: The base kinds in the order in which equal starts are listed, then the added ones.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Prefixes whose tokens carry a checksum: 30 base-62 characters, then their CRC-32 in 6 more.
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Length of the hexadecimal keywords: rare in prose, at every place of a run of 16, and few enough
#: (65,536) for the automaton to take some 10 MB of a worker and a tenth of a second to build.
HEX_GRAM = 4


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


ASSIGN = re.compile(f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
CHECKED = re.compile("(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ANCHORED = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "checked": CHECKED}


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


_automaton = None


def automaton():
    """The worker's automaton over all keywords, built once."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            a.add_word(w, ("assign", len(w)))
        a.add_word("akia", ("access", 4))
        for p in CHECKED_PREFIXES:
            a.add_word(p, ("checked", len(p)))
        for gram in product("0123456789abcdef", repeat=HEX_GRAM):
            a.add_word("".join(gram), ("hex", HEX_GRAM))
        a.make_automaton()
        _automaton = a
    return _automaton


def forget() -> None:
    global _automaton
    _automaton = None


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, leftmost and non-overlapping within a kind, in code points."""
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    free = dict.fromkeys(ANCHORED, 0)
    out = []
    # No keyword holds another of its kind, so hits come in order of their starts, and none is kept.
    for end, (kind, n) in automaton().iter(low):
        start = end - n + 1
        if start < free[kind]:
            continue
        m = ANCHORED[kind].match(text, start)
        if m is None:
            continue
        if kind == "checked":
            if base62_crc(m[1]) == m[2]:
                free[kind] = m.end()
                out.append((start, CHECKED_PREFIXES[m[0][:4]], m.end()))
            continue
        free[kind] = m.end()
        if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
            out.append((start, kind, m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[1]]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets array<struct<kind, start, end>>) for every row, by start, then kind.

    Reads ``doc_id`` and ``text``. Null and empty texts have an empty array; repeated rows are
    repeated; texts of any length are scanned whole. Offsets are code points, ends exclusive.
    """
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("secrets", pa.list_(struct))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column("doc_id"), [[{"kind": k, "start": s, "end": e} for s, k, e in find(t)] for t in b.column("text").to_pylist()])

    return map_batches(texts(docs), run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, mask: str = "[secret]") -> str:
    """``text`` with every found span, overlapping ones joined, replaced by ``mask``."""
    out, at, open_end = [], 0, -1
    for start, _, end in find(text):
        if start >= open_end:
            if open_end >= 0:
                at = open_end
            out += [text[at:start], mask]
            open_end = end
        else:
            open_end = max(open_end, end)
    return text if open_end < 0 else "".join([*out, text[open_end:]])


def masker(mask: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """What a task of ``redact`` does with its texts; it leaves no automaton in the worker."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for c in columns:
                yield pa.array([t if t is None else redacted(t, mask) for t in c.to_pylist()], pa.string())
        finally:
            forget()

    return run


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets in ``text`` masked, and ``n_chars`` (if there) following; null stays null.

    Repeated rows stay repeated, an empty table stays empty, other columns are untouched.
    """
    from verdigraph.runtime import bound_batches

    @F.arrow_udf("string")
    def masked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(masker(mask))(columns)

    bound_batches(docs.sparkSession)
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
