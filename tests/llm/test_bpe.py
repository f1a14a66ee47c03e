import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewarden.llm.bpe import Codec, digest, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ", "İstanbul ﬁ Ǆ", "é Å", "it's we'LL 'S ''d", "你好 123 ½", "x\x1cy\x85z\xa0w v", "🙂👩‍👩‍👧 ‍", "\x00\x01", "a" * 5000, "ab" * 3000 + "ß" * 700, "Ünïcödé\n\r\t text", "İ̇ ẞ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(codec, library):
    for t in ODD:
        same(codec, library, t)


def test_random_texts(codec, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def run(t):
        same(codec, library, t)

    run()


def test_cuts_are_forced(codec):
    word = "ßxqjzk" * 3
    whole = codec.merge(tuple(s for f in codec.fragments(word) for s in f))
    assert whole == [t for f in codec.fragments(word) for t in codec.merge(f)] and len(codec.fragments(word)) > 1


def test_whole_table_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in digest(docs, PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (3, "", 2), (3, "Hi  there", 2), (3, "Hi  there", 2)], "doc_id long, text string, ids int")
    got = sorted([(r.doc_id, r.n_tokens, r.decoded) for r in encode(docs, PATH).collect()], key=str)
    assert got == [(3, 0, ""), (3, 2, "hi</w> there</w>"), (3, 2, "hi</w> there</w>"), (None, 0, "")]
    assert encode(docs.limit(0), PATH).collect() == []
