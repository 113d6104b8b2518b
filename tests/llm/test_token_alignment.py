"""Alignment against the libraries and sets, text by text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from hirelake.llm import token_alignment as ta

A = Tokenizer.from_file(public_tokenizers.path(ta.FIRST))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ta.SECOND))
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tools():
    return ta.Aligner(ta.ByteLevel(ta._loaded(ta.FIRST)), ta.Pieces(ta._loaded(ta.SECOND)))


def spelled(piece, ident, side):
    if side == "B":
        return bytes([int(piece[3:5], 16)]) if B.is_byte(ident) else piece.replace("▁", " ").encode()
    codes = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return bytes(codes[ord(c) - 256] if ord(c) > 255 else ord(c) for c in piece)


def groups_of(text):
    """Pairs of id lists, by sets of ends."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sides = []
    for ids, name, ids_of in ((a, "A", A.id_to_token), (b, "B", B.id_to_piece)):
        parts = [spelled(ids_of(i), i, name) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return []
        ends, at = [], 0
        for part in parts:
            at += len(part)
            ends.append(at)
        sides.append(ends)
    common = sorted(set(sides[0]) & set(sides[1]))
    groups, x, y = [], 0, 0
    for end in common:
        x2, y2 = sides[0].index(end, x) + 1, sides[1].index(end, y) + 1
        groups.append((a[x:x2], b[y:y2]))
        x, y = x2, y2
    return groups


def plain(rows):
    """Rows as the operator returns them, from (doc_id, text)."""
    grouped = [groups_of(text) for _, text in rows]
    linked = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in grouped]
    counts = Counter(pair for one in linked for pair in one)
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for (ident, _), groups, one in zip(rows, grouped, linked, strict=True):
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                ident,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                sum(one.values()),
                sum(n for (a, b), n in one.items() if counts[a, b] == highest[a]),
                sum(n * counts[pair] for pair, n in one.items()),
                hashlib.sha256(listed.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=str)


def run(spark, rows, **kw):
    out = ta.align_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


TEXTS = ["", None, " ", "a", "plain words", "two  spaces", "café naïve", "漢字かな", "🙂🙂", "x▁y", "<|endoftext|> <s> <0x41>",
         "a\0b", "\n\n\t", "don't we'll", "1234567890" * 3, "!!!???...", "é ﬁ", " 　", "ВКонтакте"]


def test_edge_texts_and_repeated_rows(spark):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (3, "a"), (None, "plain words"), (4, "plain words")]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    out = ta.align_documents(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.collect() == []


def test_random_texts_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ta, "CHUNK_BYTES", 1000)
    rng = random.Random(6)
    words = ["the", "Zürich", "naïve", "漢字", "xqzv", "0x1F", "...", "—", "🙂", "token", "s", "aaaaaaa", "\t", "\n", "  "]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    rows += [(i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF)])) for _ in range(40))) for i in range(300, 400)]
    assert run(spark, rows) == plain(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ta.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain(rows)


def test_wide_groups_are_counted_by_distinct_ids(tools):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 5, 40), rng.integers(0, 7, 60)
    found = ta.Aligned([np.concatenate([np.arange(1, 40), [300]])], [np.concatenate([np.arange(100, 159), [300]])])
    assert found.groups.tolist() == [1] and found.links.tolist() == [2400]
    text, pair, times = tools.links(found, a, b)
    want = Counter(int(x) * tools.width + int(y) for x in a for y in b)
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == want and not text.any()


def test_gallop_from_any_hint():
    rng = np.random.default_rng(8)
    for _ in range(200):
        targets = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
        drivers = np.unique(rng.integers(0, targets[-1] + 1, rng.integers(1, 60)))
        hints = rng.integers(-5, len(targets) + 5, len(drivers))
        assert (ta.gallop(drivers, targets, hints) == np.searchsorted(targets, drivers)).all()


def test_quick_encoding_equals_the_library(tools):
    assert tools.first.quick is not None
    texts = ["".join(f"a{c}1{c} {c}{c}\n" for c in map(chr, range(lo, lo + 256)) if not 0xD800 <= ord(c) <= 0xDFFF) for lo in range(0, 0x110000, 256)]
    assert tools.first.encode(texts) == [e.ids for e in A.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    # An unusual file is left to the library.
    other = ta.ByteLevel(ta._loaded(ta.FIRST).replace(b'"add_prefix_space":false', b'"add_prefix_space":true', 1).replace(b'"add_prefix_space": false', b'"add_prefix_space": true', 1))
    assert other.quick is None and other.encode(["plain words"]) == [A.encode(" plain words").ids]


def test_long_runs(tools):
    texts = ["a" * 200_000, " " * 200_000, "漢字" * 50_000, "ab1!" * 50_000]
    a, b = tools.tokens(texts)
    found = tools.align(a, b)
    tools.links(found, np.concatenate(a), np.concatenate(b))
    assert found.groups.all()


def test_other_columns(spark):
    data = spark.createDataFrame([("x", "plain words", 1, "c")], "`d.d` string, body string, text long, chunk string")
    (row,) = ta.align_documents(data, "`d.d`", "body").collect()
    assert tuple(row)[1:] == plain([("x", "plain words")])[0][1:] and row.doc_id == "x"
