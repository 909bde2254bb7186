import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdigraph import runtime
from verdigraph.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH)
TEXTS = [None, "", " \n", "Hello  hello World's", "a<|endoftext|>b <|startoftext|>", "é É ́x Σας ΣΑΣ", "x\xa0y　z\x1cw\x85v", "long " * 30000, "東京 1234", "\x00", "a\x01b \x01 \x01\x01 c"]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_round_trip_in_id_order(spark, docs):
    tok = Tokenizer.from_file(PATH)
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(50, "same"), (50, "same"), (None, "no id")]
    manifest = token_files.write_shards(docs(rows), PATH, runtime.fresh_path(spark, "t"), end_id=1)
    got = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    some = token_files.read_shards(manifest, {50, 93}).collect()
    assert sorted(r.doc_id for r in some) == [50, 50, 93]


def test_empty_table(spark, docs):
    manifest = token_files.write_shards(docs([]), PATH, runtime.fresh_path(spark, "t"), end_id=1)
    assert token_files.read_shards(manifest).count() == 0


def shard(docs, id_bytes=2):
    class Sink(io.BytesIO):
        def close(self):
            self.all = self.getvalue()

    sink = Sink()
    w = token_files.ShardWriter(sink, id_bytes)
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4"))
    w.close()
    return sink.all


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_only_requested_frames_are_decompressed(id_bytes):
    many = [(i, [i % 60000] * 40000) for i in range(10)] + [(None, []), (11, [7])]
    data = shard(many, id_bytes)
    r = token_files.ShardReader(Source(data))
    assert [(d, ids.tolist()) for d, _, ids in r.read({7})] == [(7, [7] * 40000)] and r.frames_read == 1
    assert [(d, ids.tolist()) for d, _, ids in r.read()] == many
    # any zstandard reader sees independent frames and skips the table
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.startswith(np.array([0] * 40000, f"<u{id_bytes}").tobytes())


def test_damage_is_found():
    data = bytearray(shard([(1, [1, 2, 3] * 999)]))
    table_sum = zlib.crc32(data)
    data[-9 - 12 * 2 + 8] ^= 1
    assert zlib.crc32(data) != table_sum
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.ShardReader(Source(bytes(data))).read())
    with pytest.raises(ValueError, match="seek table"):
        token_files.ShardReader(Source(bytes(data[:-1])))


def test_long_words_are_encoded_but_not_remembered(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "MEMO_BYTES", 2000)
    texts = ["x" * 5000 + " plain", "plain words", "y" * 64 + "\x01z", *(f"w{i} v{i}" for i in range(40))]
    for _ in range(2):
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert not any(len(w) >= token_files.LONG for w in [*encoder.memo, *encoder.old])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAéÉÿßªµºΣ́'.,!-_09 \x01\x85\xa0<|>tsS", max_size=30), max_size=6))
def test_stems_cases_and_tails_as_the_library(texts):
    assert ENCODER.stems
    assert [g.tolist() for g in ENCODER.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    """Memo generations of a few words; long words are never kept."""
    monkeypatch.setattr(token_files, "MEMO_BYTES", 500)
    own = token_files.WordEncoder(PATH)
    for k in range(40):
        texts = [f"Word{chr(97 + k % 26)}, wordA. {'x' * 70}{k} stem{chr(97 + k % 7)}! {'é' * 80}"]
        assert own.encode(texts)[0].tolist() == LIBRARY.encode(texts[0], add_special_tokens=False).ids
        assert all(len(w) < token_files.LONG for w in own.memo)
