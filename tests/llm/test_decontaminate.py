import random
import re

from verdigraph.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12)):
            if w:
                windows.setdefault(tuple(w[s : s + 13]), set()).add("" if i is None else str(i))
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "a", "é", "B2"]) if r.random() < 0.6 else f"w{r.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(None, "just these"), (50, None), (51, ""), (52, "..."), (3, items[5][1]), (53, "a a a a a a a a a a a a a a a")]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(4)):
            w = r.choice(items)[1] or ""
            parts.append(", ".join(w.split()[: r.choice([13, 40])]).upper() if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(60))))
        rows.append((i, " ".join(parts)))
    rows += [(90, None), (91, ""), (92, "--"), (92, items[10][1]), (92, items[10][1]), (None, items[11][1]), (93, "a " * 200 + "!")]
    return rows, items


def items_table(spark, items):
    return spark.createDataFrame([(*x, 1, "y") for x in items], "item_id long, text string, pos int, word string")


def test_hits_equal_brute_force(spark, docs):
    rows, items = case(1)
    got = dc.contamination(docs(rows), items_table(spark, items)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got], key=str) == brute(rows, items)
    kept = dc.keep_clean(docs(rows), items_table(spark, items))
    assert kept.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(b[0]) for b in brute(rows, items) if not b[4])


def test_proximity_allows_terms_to_move(spark, docs):
    item = "alpha beta gamma delta"
    rows = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x y beta gamma delta"), (4, "beta alpha delta gamma"), (5, "alpha beta gamma")]
    phrases = dc.Phrases.of(items_table(spark, [(1, item)]))
    index = dc.build_index(docs(rows), phrases.vocabulary)
    ids = {r.row: r.doc_id for r in index.where("term is null").collect()}
    near = lambda slop: {ids[r.row] for r in dc.matches(index, phrases, slop).collect()}
    assert near(0) == {1} and near(1) == {1, 2} and near(2) == {1, 2, 3, 4}


def test_without_items_or_documents(spark, docs):
    got = dc.contamination(docs([(1, "a b")]), items_table(spark, [])).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False)]
    assert dc.contamination(docs([]), items_table(spark, [(1, "a b")])).count() == 0
