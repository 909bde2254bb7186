import gc
import inspect
import shutil

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from verdigraph.llm import bpe, common, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a secret = abcdefghijkl12345", "né à 東京 " * 9, "deadbeefdeadbeef00", "<|endoftext|> x  y", "w" * 300] * 3


def codecs():
    gc.collect()
    return sum(isinstance(x, bpe.Codec) for x in gc.get_objects())


def test_a_codec_of_its_own_gives_the_same_and_goes_with_the_task(monkeypatch):
    monkeypatch.setattr(bpe, "PORTION", 40)
    given = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": TEXTS})
    rows = lambda memo: [r for b in bpe.coder(PATH, memo)(iter([given, given])) for r in b.to_pylist()]
    want, before = rows(None), codecs()
    assert rows(1 << 10) == want and len(want) == 2 * len(TEXTS)
    assert codecs() == before


def test_encode_stage_leaves_no_codec_in_the_workers(spark, docs, tmp_path, monkeypatch):
    own = str(tmp_path / "vocabulary.json")
    shutil.copy(PATH, own)
    monkeypatch.setattr(public_tokenizers, "path", lambda name: own)
    assert corpus_pipeline.encode_stage(spark, docs(list(enumerate(TEXTS))), "").count() == len(TEXTS)
    assert len(corpus_pipeline.encode_stage(spark, docs(list(enumerate(TEXTS))), "").collect()) == len(TEXTS)

    def left(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [int(own in bpe._codecs)] * b.num_rows})

    assert {r.n for r in spark.range(400).repartition(16).mapInArrow(left, "n long").collect()} == {0}


def test_masking_leaves_no_automaton(spark, docs):
    secrets.find("x")
    out = [t for a in secrets.masker("#")(iter([pa.array([None, *TEXTS])])) for t in a.to_pylist()]
    assert out == [None, *(secrets.redacted(t, "#") for t in TEXTS)]
    list(secrets.masker("#")(iter([pa.array(TEXTS)])))
    assert secrets._automaton is None
    got = secrets.redact(docs([(1, None), (2, TEXTS[1]), (2, TEXTS[1])])).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None), *[(2, secrets.redacted(TEXTS[1]))] * 2], key=str)


def test_a_task_gives_back_also_when_it_is_cut_short(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    list(common.tidied(iter)([1, 2]))
    cut = common.tidied(lambda xs: (x for x in xs))([1, 2])
    next(cut)
    assert inspect.isgenerator(cut) and len(called) == 1
    cut.close()
    assert len(called) == 2
