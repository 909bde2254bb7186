import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigraph.llm import bitslice, simhash
from verdigraph.operators import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    up = list(range(n))
    for i, j in links:
        while up[i] != i:
            i = up[i]
        while up[j] != j:
            j = up[j]
        up[max(i, j)] = min(i, j)
    for i in range(n):
        up[i] = up[up[i]]
    return up


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\t\x0b\x1c\x85\xa0ÉZ", max_size=30))
def test_fingerprint(text):
    assert simhash.fold(simhash.shingle_hashes(text, 3)) == slow_fingerprint(text)


@pytest.mark.parametrize("words,radius,n", [(1, 2, 300), (1, 2, 64), (1, 2, 65), (2, 30, 200), (1, 0, 100), (1, 3, 130), (1, 2, 1), (1, 2, 0)])
def test_bit_sliced_pairs_and_forest(words, radius, n):
    r = np.random.default_rng(n)
    prints = r.integers(0, 2**63, (n, words), dtype="u8")
    for k in range(1, n):
        if r.random() < 0.6:
            prints[k] = prints[r.integers(0, k)]
            for _ in range(r.integers(0, radius + 3)):
                prints[k, r.integers(0, words)] ^= np.uint64(1 << int(r.integers(0, 64)))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius}
    got = {p for i, j in bitslice.near_pairs(prints, radius) for p in zip(i.tolist(), j.tolist())}
    assert got == want
    assert bitslice.forest(n, bitslice.near_pairs(prints, radius)).tolist() == groups(n, sorted(want))


def test_components(spark):
    r = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    up = groups(300, [x for x in links if x[0] != x[1]])
    got = {row.u: row.v for row in components.roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in enumerate(up) if k != v}
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_of_near_fingerprints(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = int(r.integers(0, 2**63))
    prints = {centre ^ int(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (0, 1, 1, 2, 3, 4, 5, 6) for _ in range(12)} | {int(x) for x in r.integers(0, 2**63, 50)}
    prints = sorted(prints)
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2])
    table = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in prints], "fp long")
    for limit in (simhash.BUCKET, 8):  # the second makes every larger bucket split
        monkeypatch.setattr(simhash, "BUCKET", limit)
        at = {p if p < 2**63 else p - 2**64: i for i, p in enumerate(prints)}
        links = [(at[row.u], at[row.v]) for row in simhash.near_links(table).collect()]
        assert groups(len(prints), links) == want


def test_documents(spark, docs):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, None), (9, ""), (7, " \n\t"), (3, long), (4, long.upper()), (4, long), (8, "one two"), (2, "other words here now"), (None, "ONE  two"), (None, "alone at all")]
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    assert {(i, f) for i, f, _ in got} == {(i, slow_fingerprint(t)) for i, t in rows}
    assert {i: c for i, _, c in got if i is not None} == {5: 5, 9: 5, 7: 5, 3: 3, 4: 3, 8: 8, 2: 2}
    assert {c for i, _, c in got if i is None} == {8, None}
    assert simhash.near_duplicates(docs([])).count() == 0
