import math
import zlib
from collections import Counter

import numpy as np
import pytest

from verdigraph.llm import chunks, lm


def brute(rows, order):
    docs = [((t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode() if i is not None else b"") % 10) for i, t in rows]

    def count(pred):
        c, n_docs = Counter(), 0
        for tokens, rem in docs:
            if pred(rem):
                n_docs += 1
                for k in range(1, order + 1):
                    padded = ["^"] * (k - 1) + tokens
                    c.update((k, *padded[i : i + k]) for i in range(len(tokens)))
        return c, n_docs

    def parts(c, n_docs, n, v, tokens):
        for i, w in enumerate(tokens):
            p, b, has = [1 / (v + 1), c[1, w] / max(n, 1)], 0, [True, n > 0]
            for k in range(2, order + 1):
                context = tuple((["^"] * (k - 1) + tokens)[i : i + k - 1])
                seen = n_docs if i == 0 else c[(k - 1, *context)]
                p.append(c[(k, *context, w)] / seen if seen else 0.0)
                has.append(seen > 0)
                b = b * 64 + seen.bit_length()
            yield b, p, has

    train, n_train = count(lambda r: r > 0)
    fit, n_fit = count(lambda r: r > 1)
    total = lambda c: sum(x for k, x in c.items() if k[0] == 1)
    n, v = total(train), sum(1 for k in train if k[0] == 1)
    stats = Counter((b, *p) for tokens, rem in docs if rem == 1 for b, p, _ in parts(fit, n_fit, total(fit), v, tokens))
    weights = {k[0]: [1 / (order + 1)] * (order + 1) for k in stats}
    every = [1 / (order + 1)] * (order + 1)
    for _ in range(lm.ROUNDS if stats else 0):
        e = {b: [0.0] * (order + 1) for b in weights}
        for (b, *p), times in stats.items():
            joint = [w * x for w, x in zip(weights[b], p)]
            for k in range(order + 1):
                e[b][k] += times * joint[k] / sum(joint)
        every = [sum(x[k] for x in e.values()) + lm.PRIOR for k in range(order + 1)]
        every = [x / sum(every) for x in every]
        weights = {b: [(x + lm.PRIOR) / sum(y + lm.PRIOR for y in xs) for x in xs] for b, xs in e.items()}
    out = []
    for (i, _), (tokens, rem) in zip(rows, docs):
        base = sum(math.log10((train[1, w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        s = 0.0
        for b, p, has in parts(train, n_train, n, v, tokens):
            w = [a if h else 0.0 for a, h in zip(weights.get(b, every), has)]
            s += math.log10(sum(a * x for a, x in zip(w, p)) / sum(w))
        out.append((i, rem == 0, len(tokens), sum(train[1, w] > 0 for w in tokens), n, round(base, 6), round(s, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, docs, order):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(["a", "B", "the", "of", "é", f"w{i}"], int(r.integers(0, 30))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (502, "a b"), (None, "a the"), (503, "the " * 3000)]
    got = sorted([(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in lm.score(docs(rows), order).collect()], key=str)
    assert got == brute(rows, order)


def test_empty_and_only_held_out(spark, docs):
    assert lm.score(docs([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(docs([(only, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and math.isfinite(row.score) and math.isfinite(row.base_score)


def test_context_helps_held_out_text(spark, docs):
    rows = [(i, "the cat sat on the mat and then the dog sat on the rug " * 5) for i in range(60)]
    got = [x for x in lm.score(docs(rows)).collect() if x.held_out]
    assert got and all(x.score > x.base_score for x in got)


def test_blobs():
    r = np.random.default_rng(0)
    for a in (np.zeros(0, "<u8"), r.integers(0, 2**63, 1000, dtype="<u8"), np.arange(5, dtype="<u4"), np.array([-1, 2], "<i8")):
        assert (chunks.expand(chunks.squeeze(a)) == a).all() and chunks.expand(chunks.squeeze(a)).dtype == a.dtype
    a = np.sort(r.integers(0, 2**64, 1000, dtype="<u8"))
    assert (chunks.expand_sorted(chunks.squeeze_sorted(a)) == a).all()
