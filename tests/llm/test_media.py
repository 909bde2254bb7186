import hashlib

import numpy as np

from verdigraph.llm import media


def test_round_trip_and_equal_values(spark, docs):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 5000), (5, "é" * 5000), (None, "tail"), (4, "é" * 5000)]
    got = media.features(media.with_media(docs(rows))).collect()
    assert len(got) == len(rows)
    values = {}
    for r in got:
        raw = next((t or "") for i, t in rows if i == r.doc_id).encode()
        assert r.n_bytes == len(raw) and len(r.payload) % 576 == 0 and len(r.payload) > 0
        assert bytes(r.payload) == raw + b"\xff" * (len(r.payload) - len(raw))
        assert media.from_wav(bytes(r.media)) == bytes(r.payload)
        assert len(r.codes) == len(r.times)
        values.setdefault(raw, set()).add(hashlib.sha256(str((r.codes, r.times)).encode()).hexdigest())
    assert all(len(v) == 1 for v in values.values())
    assert media.with_media(docs([])).count() == 0


def slow_peaks(m):
    level = np.round(m, 3)
    level[:, 0] = 0
    out = []
    for t, row in enumerate(level):
        found = [(-v, f) for f, v in enumerate(row) if v > 0 and v == row[max(0, f - media.NEIGHBOURS) : f + media.NEIGHBOURS + 1].max()]
        out += [(t, f) for _, f in sorted(found)[: media.PEAKS]]
    return out


def test_fingerprint_equals_brute_force():
    samples = bytes(np.random.default_rng(1).integers(0, 256, 576 * 5, "u1"))
    spec = media.spectrogram(samples)
    t, f = media.peaks(spec)
    assert list(zip(t.tolist(), f.tolist())) == slow_peaks(spec)
    peaks = slow_peaks(spec)
    pairs = sorted((t1, f1 << 12 | f2 << 2 | t2 - t1) for t1, f1 in peaks for t2, f2 in peaks if 0 <= t2 - t1 <= media.SPAN and (t1 != t2 or f2 > f1))
    codes, times = media.fingerprint(samples)
    assert list(zip(times.tolist(), codes.tolist())) == pairs


def test_a_pure_tone_peaks_at_its_bin():
    n = np.arange(media.FRAME * 4)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 40 * n / media.FRAME)).astype("u1").tobytes()
    t, f = media.peaks(media.spectrogram(tone))
    assert set(f[np.unique(t, return_index=True)[1]]) == {40}


def test_stripes_change_nothing(monkeypatch):
    samples = media.padded(bytes(np.random.default_rng(9).integers(0, 256, 40 * 576, dtype="u1")))
    whole = media.fingerprint(samples)
    for stripe in (1, 2, 7):
        monkeypatch.setattr(media, "STRIPE", stripe)
        assert all((a == b).all() for a, b in zip(whole, media.fingerprint(samples)))
