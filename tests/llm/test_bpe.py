import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdigraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [None, "", " ", "  ", "a", " a", "a ", "a  b", "it's they'LL 'll", "x\n\n y\t z \n", "né à 東京 😀", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "\x00\x1c\x85\xa0 　x", "aaaa" * 5000, "1 234 5!?", "é é", "a\xa0 b", " \n", "​ zero"]


LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


def test_whole_texts_equal_the_library(spark, docs):
    rows = list(enumerate(TRICKY)) + [(1, "repeated"), (1, "repeated"), (None, "no id")]
    got = bpe.encode_decode(docs(rows), PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got) == sorted((str(i), library(t), t or "") for i, t in rows)


def test_empty_table(spark, docs):
    assert bpe.encode_decode(docs([]), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbe rst'\n\t,.1é<|>endoftx\xa0"), max_size=40))
def test_random_texts_equal_the_library(text):
    own = bpe.codec(PATH)
    assert own.encode(text) == library(text)
    assert own.decode(own.encode(text)) == text


def test_memo_keeps_two_generations_of_bytes():
    memo = bpe.Memo(lambda k: [k], lambda k: k.encode(), size=3 * (bpe.ENTRY_BYTES + 2))
    assert [memo[k] for k in "abcdab"] == [k.encode() for k in "abcdab"]
    assert len(memo) <= 3 and len(memo.old) <= 3
    long = "x" * bpe.LONG
    assert memo[long] == long.encode() and long not in memo and long not in memo.old


def test_a_long_text_without_spaces_is_not_remembered():
    import public_tokenizers

    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    text = "ab" * 200_000
    assert codec.decode(codec.encode(text)) == text
    assert sum(map(len, codec.pieces)) < 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab  '\n,1é<|endoftext|>\xa0"), max_size=25) | st.just("a<|endoftext|> b"), max_size=6))
def test_batches_equal_the_library(texts):
    assert bpe.codec(PATH).encode_all(texts) == [library(t) for t in texts]
