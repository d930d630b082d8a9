"""Encoding against the tokenizer library: equal ids on hostile texts and on the test documents."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm.bytescan import text_slices
from tallyloom.llm.tokens import DEFAULT_VOCABULARY, Encoder, encode_corpus, load_vocabulary, perfect_hash, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
HOSTILE = [
    None, "", " ", "   ", "\n", " \n", "a", "'s's 're'll  x's ''s \n\n 't a  b\t\t", "don't  you're\r\n\r\n  end   ", "I'LL I'll 'll", "a\x1cb\x85c d　e​", "½x٣４ ²", "'d'd'm", "x'",
    "<|endoftext|> is text", "专利文献公开了温室和牲畜栏。", "é" * 3000, "a" * 20000, "0" * 777 + " " + " " * 500 + "\n", "😀👩‍👩‍👧 ß", "﻿bom", "tab\tand\rcr\r\n", "a'b'ca'll", "1's 2'd", "\x00nul",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encode(texts, most_bytes=1 << 20):
    enc, out = Encoder(load_vocabulary(DEFAULT_VOCABULARY)), []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string()), most_bytes):
        ids, per = enc.encode(data, offsets)
        ends = np.r_[0, np.cumsum(per)]
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


@pytest.mark.parametrize("most_bytes", [1, 40, 1 << 20])
def test_hostile_texts(library, most_bytes):
    assert encode(HOSTILE, most_bytes) == library(HOSTILE)


def test_random_texts(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), st.sampled_from(" '\nstrevmld a1"))), max_size=8))
    def check(texts):
        assert encode(texts) == library(texts)

    check()


def test_documents(library, spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(folder)
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], library([r[1] for r in rows])))
    assert {r[0]: list(r[1]) for r in encode_corpus(docs).collect()} == want
    assert {r[0]: r[1] for r in token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}


def test_empty_table_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, None, None)], "doc_id long, text string, ids long")
    assert encode_corpus(df.limit(0)).count() == 0
    got = encode_corpus(df).collect()
    assert sorted(len(r["ids"]) for r in got) == [0, 2, 2]
    assert token_counts(df, keep=("doc_id", "ids")).columns == ["doc_id", "ids", "n_tokens"]


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    _, slot = perfect_hash(h)
    assert sorted(slot.tolist()) == list(range(5000))
