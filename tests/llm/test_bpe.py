"""Byte-level BPE against tiktoken, and the round trip."""

from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hirelake.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.coder()


@pytest.fixture(scope="module")
def truth():
    ranks = bpe.load_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_perfect_hash_is_minimal_and_exact():
    vocabulary = bpe.load_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    hashed = bpe.PerfectHash.build(vocabulary)
    assert len(hashed.keys) == len(vocabulary)
    assert all(hashed.get(key) == rank for key, rank in vocabulary.items())
    rng = random.Random(1)
    for _ in range(5000):
        other = rng.randbytes(rng.randrange(1, 9))
        assert hashed.get(other) == vocabulary.get(other)


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "a", "it's  the\n\n end ", "<|endoftext|>", "日本語 текст العربية 😀👩‍👩‍👧", "a" * 30_000, "\r\n\t " * 4000, "\x00\x1c\x85 x"],
)
def test_edge_texts(coder, truth, text):
    assert ids(coder, text) == truth.encode_ordinary(text or "")
    assert coder.decode(coder.encode(text)) == (text or "").encode()


def test_every_character(coder, truth):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):
        text = "".join(f"a{c}1 {c}b  " for c in points[at : at + 997 : 7])
        assert ids(coder, text) == truth.encode_ordinary(text)


def test_random_texts(coder, truth):
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("aehrt nós'LL\n9!été中") for _ in range(rng.randrange(200)))
        assert ids(coder, text) == truth.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_memory_of_pre_tokens_is_bounded(coder, monkeypatch, truth):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder.known.clear()
    text = " ".join(f"w{i}ö" for i in range(500))
    assert ids(coder, text) == truth.encode_ordinary(text)
    assert len(coder.known) <= 50


def test_query_against_tiktoken(spark, truth):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, folder).collect()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        expected = truth.encode_ordinary(doc.text or "")
        row = got.pop(doc.doc_id)
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
    assert not got


def test_rows_and_columns(spark, truth):
    docs = spark.createDataFrame([(1, None, "x"), (2, "tea", "y"), (2, "tea", "y"), (None, "", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.n_tokens, list(r.ids)) for r in bpe.encode_documents(docs).collect()))
    tea = truth.encode_ordinary("tea")
    assert got == [(0, 0, []), (1, 0, []), (2, len(tea), tea), (2, len(tea), tea)]
    assert bpe.encode_documents(docs.limit(0)).count() == 0
