import random

import numpy as np
import pytest

from verdigraph.llm import suffix


def brute(rows):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 6)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [r.choice(passage)[r.randrange(30) :] if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(30))) for _ in range(r.randrange(5))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 350), (105, "ab" * 200), (106, rows[3][1]), (107, "x" * 101 + "y" * 250), (108, rows[5][1] * 3)]
    return rows


@pytest.mark.parametrize("changes", [{}, {"PIECE": 150}, {"SPLIT": 1, "CHUNK_BYTES": 900}, {"BATCH": 300, "CHUNK_BYTES": 700}, {"SPLIT": 3, "FOLLOWERS": 2, "CHUNK_BYTES": 300}])
def test_removal_equals_brute_force(spark, docs, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(suffix, name, value)
    rows = texts(len(changes))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(docs(rows[::-1])).collect())
    assert got == brute(rows)


def test_null_ids_come_first_and_equal_rows_repeat(spark, docs):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(300))
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove_repeats(docs([(1, text), (1, text), (None, text)])).collect())
    assert got == [("1", 300), ("1", 300), ("None", 0)]
    assert suffix.remove_repeats(docs([])).count() == 0


def test_copies_and_a_common_line_in_many_chunks(spark, docs, monkeypatch):
    """A hot K-gram with many copies of one kind, and many kinds around one 93-byte core."""
    for name, value in (("SPLIT", 4), ("FOLLOWERS", 3), ("CHUNK_BYTES", 600)):
        monkeypatch.setattr(suffix, name, value)
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    copy, core = some(260), some(93)
    rows = [(i, copy) for i in range(30)] + [(100 + i, some(20) + core + some(r.choice([5, 6, 7, 30]))) for i in range(40)] + [(200 + i, some(50) + core + "same end" + some(9)) for i in range(20)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix.remove_repeats(docs(rows[::-1])).collect())
    assert got == brute(rows)


def test_rows_of_one_id_do_not_depend_on_how_they_are_dealt(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 400)
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = some(150)
    rows = [(7, some(50) + shared + some(i)) for i in range(12)] + [(None, shared + some(3)), (None, some(3) + shared)]
    found = []
    for n in (1, 3, 5):
        r.shuffle(rows)
        found.append(sorted((str(x.doc_id), x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix.remove_repeats(docs(rows).repartition(n)).collect()))
    assert found[0] == found[1] == found[2] and sum(x[2] == 0 for x in found[0]) == 1


def test_only_compared_bytes_go():
    """Runs whose hashes agree by accident are told apart."""
    body = bytes(np.random.default_rng(1).integers(97, 105, 400, "u1"))
    runs = suffix.Runs(body, np.array([400]))
    runs.key[:], runs.whole[:] = 5, 6
    first, later = suffix.local_first(runs, body)
    assert len(first) == 1 and not len(later) and len(runs.key) > 2


def test_query_returns_the_contract(spark, tmp_path):
    import hashlib

    rows = texts(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = len(spark.catalog.listTables())
    got = suffix.query(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows)]
    assert len(spark.catalog.listTables()) == before


def test_family_marks_what_came_before():
    r = np.random.default_rng(0)
    family, seen = suffix.Family(), set()
    for size in (5, 1, 40, 3, 100, 7, 7, 250):
        batch = r.integers(97, 100, (size, 4), "u1")
        want = []
        for row in batch:
            want.append(row.tobytes() in seen)
            seen.add(row.tobytes())
        assert family.add(batch.view("S4").ravel()).tolist() == want
        sizes = [len(level) for level in family.levels]
        assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
