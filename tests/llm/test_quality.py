import itertools
import zlib

import numpy as np

from verdigraph.llm import quality


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    unary, trans = r.normal(size=(2, 5)), r.normal(size=(2, 2))
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    marginal, pairs, log_z = quality.forward_backward(np.where(mask, unary, 0), mask, trans)
    for k, n in enumerate((5, 3)):
        weight = {s: np.exp(sum(unary[k, t] * s[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        assert np.isclose(log_z[k], np.log(z))
        assert np.allclose(marginal[k, :n], [sum(w for s, w in weight.items() if s[t]) / z for t in range(n)])
        for a, b in itertools.product((0, 1), repeat=2):
            assert np.isclose(pairs[k, a, b], sum(w * sum((x, y) == (a, b) for x, y in zip(s, s[1:])) for s, w in weight.items()) / z)


def labelled(spark):
    r = np.random.default_rng(1)
    good = lambda: "\n".join("The " + " ".join(r.choice(["of", "cat", "house", "running", "and", "tree"], 12)) + "." for _ in range(4))
    bad = lambda: "\n".join(["BUY NOW!!! " * 6] * int(r.integers(1, 5)))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    return rows, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark, docs):
    rows, labels = labelled(spark)
    rows += [(900, None), (901, ""), (902, "\n\n"), (902, "\n\n"), (None, "x" * 100000), (903, "line\n" * 3000)]
    d = docs(rows)
    field = quality.train(d, labels)
    got = quality.score(d, field).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 300 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 3 > 0) for x in held]) > 0.97
    assert len({x.score for x in got if x.doc_id in (900, 901)}) == 1
    kept = quality.keep_good(d, field)
    assert kept.columns == d.columns
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.score >= 0.5}


def test_labels_of_the_held_out_rows_are_not_learned(spark, docs):
    rows, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    a, b = (quality.train(docs(rows), x) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = quality.train(docs([(1, "a")]), none)
    assert [x.score for x in quality.score(docs([(1, "a"), (2, None)]), field).collect()] == [0.5, 0.5]
    assert quality.score(docs([]), field).count() == 0 and quality.keep_good(docs([]), field).count() == 0
