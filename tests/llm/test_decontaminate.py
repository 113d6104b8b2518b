"""Decontamination against plain approximate substring search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from hirelake.llm import decontaminate as dc


def plain_edits(pattern, text):
    """Least edits of the whole pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = rng.choice("xyz")
            case 1:
                out.insert(at, rng.choice("xyz"))
            case _:
                del out[at]
    return "".join(out)


def fixture():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(6, 40))) for i in range(14)] + [(50, "Tiny"), (51, None), (52, ""), (53, "été " * 9)]
    docs = []
    for d in range(60):
        text = prose(rng, rng.randrange(40))
        if d % 3:
            item = rng.choice(items[:14])[1]
            text += ".\n" + changed(rng, item, rng.randrange(0, 1 + len(item) // 6)).upper() + " " + prose(rng, 9)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "short"), (None, items[3][1]), (103, items[3][1]), (103, items[3][1]), (104, "É" + "té été," * 30)]
    return docs, items


def plain(docs, items):
    out = []
    for d, text in docs:
        for i, item in items:
            pattern = dc.normalise(item)
            if len(pattern) >= dc.Q:
                edits = plain_edits(pattern, dc.normalise(text))
                if edits <= dc.budget(len(pattern)):
                    out.append((d, i, edits))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_chars", [dc.SLICE_CHARS, 300])
def test_finds_what_plain_search_finds(spark, slice_chars):
    docs, items = fixture()
    got = dc.find(
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string"),
        slice_chars=slice_chars,
    ).collect()
    want = plain(docs, items)
    assert len(want) > 20
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=str) == want


def test_clean_documents_stay(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, edits int")
    kept = dc.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    dirty = {d for d, _, _ in plain(docs, items)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in dirty)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string")
    assert dc.find(docs.limit(0), items).count() == 0
    assert dc.find(docs, items.limit(0)).count() == 0
    assert dc.decontaminate(docs, items.limit(0)).count() == 1


def test_alignment_at_the_borders_of_a_text():
    pattern, text = dc._points("abcdefghij"), dc._points("cdefghij")
    cost, end = dc.align([pattern], [text], np.array([-4]), 8)
    assert (cost.tolist(), end.tolist()) == ([2], [8])
