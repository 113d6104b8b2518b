"""SimHash: fingerprints and groups against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from hirelake.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """component_id per row of (doc_id, fingerprint)."""
    root = {f: f for _, f in rows}
    codes = sorted(root)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return [least.get(find(f)) for _, f in rows]


@pytest.mark.parametrize(
    "text",
    [None, "", " \t\n", "one", "one two", "One TWO three four", "É À x\x0by\x1cz " * 9, "a b " * 70_000],
)
def test_fingerprint_of_edge_texts(text):
    if text and len(text) > 10_000:
        assert simhash.fingerprint(text) == plain_fingerprint(text[:4000])  # the same two shingles in turn
    else:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_codes(rng, groups, size):
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    out = []
    for b in base:
        for _ in range(size):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            out.append(int(b) ^ sum(1 << int(f) for f in flips))
    return out


@pytest.mark.parametrize("hot", [simhash.HOT_NODE, 3])
def test_links_connect_what_brute_force_connects(spark, hot):
    codes = sorted(set(near_codes(np.random.default_rng(5), 25, 12)) | {0, 1, 7, 15, (1 << 64) - 1})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), hot=hot).collect()
    assert all(((u ^ v) & (1 << 64) - 1) for u, v in edges)
    from hirelake.llm.components import components

    joined = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    got = pd.Series([joined.get(c, c) for c in signed])
    want = pd.Series(plain_groups(list(zip(range(len(codes)), codes, strict=True))))
    assert (got.groupby(want).nunique() == 1).all() and (want.groupby(got).nunique() == 1).all()


def documents(spark):
    rows = [
        (1, "the cat sat on the mat and looked at the old dog", "en"),
        (2, "The cat sat on the mat and looked at the old dog", None),
        (3, None, "en"),
        (4, "", "de"),
        (5, "alone here", None),
        (5, "alone here", None),
        (6, "something else entirely, with nothing in common at all", "fr"),
        (None, "alone HERE", "en"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_groups_of_documents(spark):
    docs = documents(spark)
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.near_duplicates(docs, ["doc_id"]).collect())
    plain = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    signed = [f - (1 << 64) if f >> 63 else f for _, f in plain]
    want = sorted((d or -1, s, c) for (d, _), s, c in zip(plain, signed, plain_groups(plain), strict=True))
    assert got == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6]


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    assert simhash.near_duplicates(docs, ["doc_id"]).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    plain = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    for (doc, code), group in zip(plain, plain_groups(plain), strict=True):
        assert (got[doc].fingerprint, got[doc].component_id) == (f"{code:016x}", group)
