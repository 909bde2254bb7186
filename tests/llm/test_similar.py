import random

import numpy as np

from verdigraph.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_groups_equal_brute_force(spark, docs):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, bases = [], [[word() for _ in range(r.choice([60, 200, 400]))] for _ in range(12)]
    for i in range(150):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 3, 8])):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "Two words"), (203, "two  WORDS"), (204, "two word")]
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs([*rows, (None, "two words")])).collect()}
    want = {i: root(i) for i in sets}
    assert got == want
    kept = similar.keep_one_each(docs([*rows, (None, "two words"), (202, "Two words")]))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted([*{*want.values()}, 202])
    assert kept.columns == docs([]).columns and kept.where("doc_id is null").count() == 1


def rows_of(**columns):
    return similar.Rows({c: np.asarray(x) for c, x in columns.items()})


def test_the_nearest_of_other_labels_is_proposed():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**62, (1, 2))
    prints = np.repeat(base, 300, axis=0)
    for k in range(300):
        prints[k, k % 2] ^= int(r.integers(0, 2**62)) & int(r.integers(0, 2**62)) & int(r.integers(0, 2**62))
    label = np.where(r.random(300) < 0.3, np.arange(300), 7)
    size = r.integers(90, 130, 300)
    rows = rows_of(node=np.arange(300), label=label, size=size, a=prints[:, 0], b=prints[:, 1])
    want = {}
    for i in range(300):
        for j in range(300):
            d = int(np.bitwise_count(rows.prints[i] ^ rows.prints[j]).sum())
            if label[j] < label[i] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and d <= similar.RADIUS:
                want[i] = min(want.get(i, (999, 0)), (d, j))
    u, v, d = similar.nearest(rows, similar.bits_near(rows, np.arange(300)))
    assert {i: (x, j) for i, j, x in zip(u.tolist(), v.tolist(), d.tolist())} == want and len(want) > 50


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300, 3000):
        for m in (0, 1, n // 4, 3 * n):
            common, p, q = (np.unique(r.integers(0, 2**63, k).astype("u8")) for k in (n, m, m // 2))
            x, y = np.union1d(common, p), np.union1d(common, q)
            assert similar.parity_distance(similar.parity(x), similar.parity(y)) <= len(np.setxor1d(x, y))
    assert similar.parity_distance(similar.parity(x), similar.parity(x)) == 0


def test_sketches_of_rows_keep_every_similar_pair(monkeypatch):
    r = np.random.default_rng(4)
    sets = []
    for n in (3, 20, 150, 900):
        base = r.integers(0, 2**63, n).astype("u8")
        sets += [np.unique(np.concatenate([base[r.random(n) > 0.06], r.integers(0, 2**63, n // 12).astype("u8")])) for _ in range(25)]
    i, j = np.triu_indices(len(sets), 1)
    near = np.array([similar.similar(sets[a], sets[b]) for a, b in zip(i, j)])
    for bits in (64, 256, 1024):
        rows = rows_of(size=[len(s) for s in sets], tip=np.array([similar.parity(s, bits) for s in sets], object))
        got = {(a, b) for x, y in similar.not_too_far(rows, [(i[:3000], j[:3000]), (i[3000:], j[3000:])]) for a, b in zip(x.tolist(), y.tolist())}
        assert {(a, b) for a, b in zip(i[near].tolist(), j[near].tolist())} <= got
    assert near.sum() > 300 and len(got) < len(i) / 2


def test_empty(spark, docs):
    assert similar.similar_groups(docs([])).count() == 0
    assert similar.keep_one_each(docs([])).count() == 0


def test_short_near_pairs_are_all_found(spark, docs):
    """Eight words and the same with a ninth: 4 of 5 shingles, which SimHash misses in one pair of five."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(150):
        words = [word() for _ in range(8)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, word()]))]
    assert all(len(shingles(rows[i][1])) == 4 + i % 2 for i in range(300))
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_prefix_pairs_hold_every_similar_pair(monkeypatch):
    """Against all pairs, with hot shingles, small and large runs, and similarities about 0.8."""
    r = np.random.default_rng(5)
    hot = r.integers(0, 2**63, 60).astype("u8")
    sets = []
    for n in (1, 3, 4, 5, 9, 10, 40, 90):
        for _ in range(6):
            base = r.integers(0, 2**63, n).astype("u8")
            for _ in range(6):
                kept = base[r.random(n) > r.choice([0, 0.05, 0.1, 0.15])]
                sets.append(np.unique(np.concatenate([kept, r.choice(hot, min(n // 4, 8)), r.integers(0, 2**63, int(r.integers(0, n // 8 + 2))).astype("u8")])))
    sets = [s for s in sets if len(s)] + [hot[:k].copy() for k in range(40, 60)]
    sets = [np.unique(s) for s in sets]
    counts = np.bincount(similar.slots(np.concatenate(sets)), minlength=similar.SLOTS)
    key, node, size, place = np.array(sorted((int(k.astype("i8")), n, len(s), place) for n, s in enumerate(sets) for place, k in enumerate(similar.prefix(s, counts))), "i8").T
    both = lambda p, q: len(np.intersect1d(p, q))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if both(sets[i], sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - both(sets[i], sets[j])) - 1e-9}
    assert len(want) > 100
    for block in (2048, 8):
        monkeypatch.setattr(similar, "BLOCK", block)
        for groups in (len(sets), 3):
            label = node % groups
            rows = rows_of(key=key, node=node, label=label, size=size, place=place)
            got = {(min(a, b), max(a, b)) for i, j in similar.prefix_pairs(rows) for a, b in zip(node[i].tolist(), node[j].tolist())}
            assert {(i, j) for i, j in want if i % groups != j % groups} <= got
            assert all(a % groups != b % groups for a, b in got)


def near_copies(n, seed, least=40):
    """Rows of a few large groups with many near pairs about 0.8, and ids that stand on two rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(least * (k + 1))] for k in range(3)]
    rows = []
    for i in range(n):
        words = list(bases[min(r.randrange(6), 2)])
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(i), root(rows[y][0])))
                up[b] = a
    return {i: root(i) for i in up}


def test_hot_keys_are_split_without_loss(spark, docs, monkeypatch):
    rows = near_copies(260, 11)
    for c, n in (("HOT", 16), ("GRID", 8), ("RAYS", 4), ("BLOCK", 16), ("ROWS", 64)):
        monkeypatch.setattr(similar, c, n)
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs(rows)).collect()}
    assert got == brute_groups(rows)


def test_prefixes_alone_find_all(spark, docs, monkeypatch):
    """Without any SimHash candidate."""
    monkeypatch.setattr(similar, "RADIUS", 0)
    monkeypatch.setattr(similar, "ROUNDS", 1)
    rows = near_copies(150, 12)
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs(rows)).collect()}
    assert got == brute_groups(rows)


def test_repeated_ids_with_different_texts_lose_no_link(spark, docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(12):
        a, b = ([word() for _ in range(80)] for _ in range(2))
        rows += [(3 * g, " ".join(a)), (3 * g, " ".join(b)), (3 * g + 1, " ".join([*b[:40], word(), *b[41:]]))]
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs(rows)).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_nothing_stays_behind(spark, docs):
    import glob

    from verdigraph import runtime

    before = {t.name for t in spark.catalog.listTables()}
    folder = runtime.shared_dir(spark).removeprefix("file://") + "/verdigraph/*"
    files = set(glob.glob(folder))
    groups = similar.similar_groups(docs(near_copies(60, 13)))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert set(glob.glob(folder)) - files == {groups._verdigraph_path.removeprefix("file://")}


def test_groups_of_a_corpus_equal_all_pairs(spark):
    """All documents of sf0.01: recall and precision are one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {x.doc_id: x.component_id for x in similar.similar_groups(docs).collect()}
    assert got == brute_groups(rows) and sum(i != c for i, c in got.items()) > 20
