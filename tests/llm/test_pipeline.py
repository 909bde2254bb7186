import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute
from test_secrets import brute as spans
from test_similar import shingles
from tokenizers import Tokenizer

import corpus_pipeline
from verdigraph.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        out.append((got.columns, [r.asDict() for r in got.collect()]))
        docs = spark.createDataFrame(out[-1][1], got.schema) if out[-1][1] else got
    return spark.read.parquet(f"{SF}/documents.parquet").columns, [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], out


def test_columns_stay(stages):
    columns, _, out = stages
    assert len(out) == 5 and all(c == columns for c, _ in out[:-1])


def test_quality_drops_what_labels_mark(stages):
    _, before, out = stages
    kept = {r["doc_id"] for r in out[0][1]}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.9
    assert quality.TRAIN_DOCS and {r["doc_id"] for r in before} >= kept


def test_one_of_each_group_stays(stages):
    _, _, out = stages
    before, after = out[0][1], {r["doc_id"] for r in out[1][1]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    up = {i: i for i in sets}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                for x in ids:
                    if up[x] in (a, b):
                        up[x] = min(a, b)
    assert after == set(up.values())


def test_contaminated_rows_go(stages):
    _, _, out = stages
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {b[0] for b in brute([(r["doc_id"], r["text"]) for r in out[1][1]], items) if not b[4]}
    assert {r["doc_id"] for r in out[2][1]} == want


def test_secrets_are_masked_and_nothing_else_changes(stages):
    _, _, out = stages
    before, after = ({r["doc_id"]: r for r in out[k][1]} for k in (2, 3))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not spans(before[i]["text"]):
            assert r == before[i]


def test_ids_equal_the_library(stages):
    _, _, out = stages
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in out[3][1]}
    assert texts.keys() == {r["doc_id"] for r in out[4][1]}
    for r in out[4][1]:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = {r.doc_id: bytes(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: bytes(r["token_ids"]) for r in stages[2][4][1]}
