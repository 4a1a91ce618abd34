"""Byte-level BPE beside the tokenizer's own library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from glossmark.llm import byte_bpe
from glossmark.llm.queries import tokenizer_definition

RANKS = tokenizer_definition("byte_bpe_50k.tiktoken")
EXTRA = ["'s don't we'll", "x  \n\n  y\t\tz   ", "<|endoftext|> <|endoftext|>", "日本語テキスト 12345 ½²", "a" * 70_000, " ", "\x00\x85  　q", "\U0001f600‍ 🏽"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts(spark, edge_docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    return edge_docs.unionByName(more, allowMissingColumns=True)


@pytest.mark.parametrize("block_bytes", [300, 1 << 24])
def test_ids_and_round_trip(texts, library, block_bytes):
    got = byte_bpe.encode(texts, RANKS, public_tokenizers.PATTERN, keep=("source", "key"), output="ids", block_bytes=block_bytes).collect()
    want = [(d.doc_id, d.source, library.encode_ordinary(d.text or ""), (d.text or "").encode()) for d in texts.collect()]
    assert sorted(((r.doc_id, r.source, r.ids, bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)


def test_digests(texts, library):
    got = byte_bpe.encode(texts, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for d in texts.collect():
        ids = np.array(library.encode_ordinary(d.text or ""), "<u4")
        want.append((d.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(no_docs):
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_answers_of_another_order_are_refused():
    known = byte_bpe._Answers()
    known.parts.append((np.array([0]), np.array([1]), np.array([5])))
    with pytest.raises(ValueError, match="another order"):
        known.table(2)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, output="ids").collect()}
    assert all(got[d.doc_id].ids == library.encode_ordinary(d.text or "") for d in docs.collect())
