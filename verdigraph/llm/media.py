"""Media columns: bytes as 8-bit WAV, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload of any kind becomes the samples of a mono WAV file (one byte a sample, so nothing is
lost). Reading uses the ``wave`` module. A fingerprint is a set of peak pairs of the spectrogram:
anchor peak, later peak and the frames between them packed in one integer, stored with the anchor's
frame as two arrays of equal length (``codes`` and ``times``), ordered by time, then code.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, map_batches, portions, texts

RATE = 8_000
#: Samples are stored in whole blocks of this many; the last is filled up with PAD.
BLOCK = 576
PAD = 255
FRAME, HOP = 576, 288
#: Peaks kept a frame, neighbouring bins a peak must exceed, and later frames a pair may span.
PEAKS, NEIGHBOURS, SPAN = 3, 4, 3

#: Frames transformed at a time.
STRIPE = 4096

_WINDOW = np.hanning(FRAME)


def padded(data: bytes) -> bytes:
    """``data`` filled up with byte PAD to a positive multiple of BLOCK."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected mono 8-bit samples")
        return w.readframes(w.getnframes())


def spectrogram(samples: bytes) -> np.ndarray:
    """Magnitudes, frames x bins, of overlapping Hann-windowed frames; one frame at least."""
    x = np.frombuffer(samples, "u1").astype(np.float64) - 128.0
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1))


def peaks(magnitude: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of up to PEAKS local maxima a frame, strongest first; ties go to the lower bin."""
    level = np.round(magnitude, 3)
    level[:, 0] = 0.0
    best = level.copy()
    for d in range(1, NEIGHBOURS + 1):
        np.maximum(best[:, d:], level[:, :-d], out=best[:, d:])
        np.maximum(best[:, :-d], level[:, d:], out=best[:, :-d])
    strength = np.where((level == best) & (level > 0), level, 0.0)
    top = np.argsort(-strength, axis=1, kind="stable")[:, :PEAKS]
    t = np.repeat(np.arange(len(level)), PEAKS)
    f = top.ravel()
    keep = strength[t, f] > 0
    return t[keep], f[keep]


def peaks_of(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``peaks`` of a whole file, transformed STRIPE frames at a time: a frame's peaks are its own."""
    found = []
    for at in range(0, max(1, (len(samples) - FRAME) // HOP + 1), STRIPE):
        t, f = peaks(spectrogram(samples[at * HOP : (at + STRIPE - 1) * HOP + FRAME]))
        found.append((t + at, f))
    t, f = zip(*found)
    return np.concatenate(t), np.concatenate(f)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes int32, times int32) of every pair of peaks up to SPAN frames apart; within a frame the lower bin comes first."""
    t, f = peaks_of(samples)
    per = np.bincount(t, minlength=int(t[-1]) + 1 if len(t) else 1)
    first = np.concatenate([[0], np.cumsum(per)])
    codes, times = [], []
    for gap in range(SPAN + 1):
        has = t + gap < len(per)
        a = np.flatnonzero(has)
        n = per[t[a] + gap]
        left = np.repeat(a, n)
        right = np.repeat(first[t[a] + gap] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(a) else a
        if not gap:
            upward = f[right] > f[left]
            left, right = left[upward], right[upward]
        codes.append(f[left] << 12 | f[right] << 2 | gap)
        times.append(t[left])
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((codes, times))
    return codes[order].astype("<i4"), times[order].astype("<i4")


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id long, n_bytes long, media binary): each whole text's UTF-8 bytes as a WAV column.

    Reads ``doc_id`` and ``text``; null and empty texts become one block of padding. Rows map one
    to one, without a shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in portions(y, "text")):
            raw = b.column("text").cast(pa.binary()).to_pylist()
            yield batch(schema, b.column("doc_id"), [len(r) for r in raw], [to_wav(padded(r)) for r in raw])

    return map_batches(texts(docs), run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored media hold, read back by the ``wave`` module.

    Takes (doc_id, n_bytes, media) and returns (doc_id, n_bytes, payload binary, media binary, codes
    array<int>, times array<int>). Equal media give equal values: each file is transformed alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in portions(y, "media")):
            media_ = b.column("media").to_pylist()
            payload = [from_wav(m) for m in media_]
            prints = [fingerprint(p) for p in payload]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c, _ in prints])]).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[k] for p in prints]) if prints else np.zeros(0, "i4"), pa.int32())) for k in (0, 1)]
            yield batch(schema, b.column("doc_id"), b.column("n_bytes"), payload, b.column("media"), *lists)

    return map_batches(media, run, "doc_id long, n_bytes long, payload binary, media binary, codes array<int>, times array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the stored media. The arrays are reduced JVM-side: their text is hashed."""
    found = features(with_media(documents(spark, sf_dir)))
    text = F.concat_ws("|", F.array_join("codes", ","), F.array_join("times", ","))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), F.sha2(text.cast("binary"), 256)).alias("feature"),
    )
