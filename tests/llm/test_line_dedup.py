"""Line deduplication against a plain version over all pairs."""

from __future__ import annotations

import random

import pytest

from hirelake.llm import line_dedup as ld


def is_common_order(a, b, found):
    return all(a[i] == b[j] for i, j in found) and all(
        p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False)
    )


def test_patience_finds_ordered_matches():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(25))]
        assert is_common_order(a, b, ld.patience(a, b))
    whole = list(range(500))
    assert ld.patience(whole, whole) == [(i, i) for i in whole]
    moved = [*range(100, 200), *range(100), *range(200, 300)]
    assert len(ld.patience(moved, list(range(300)))) == 200


def test_blocks_need_their_words():
    assert ld.common_blocks([1, 2, 3, 9, 4], [7, 1, 2, 3, 8, 4], [5, 5, 5, 1, 14], 15) == [0, 1, 2]
    assert ld.common_blocks([1, 2], [1, 2], [5, 5], 11) == []
    assert ld.common_blocks([], [1], [], 1) == []


def test_moved_blocks():
    words = [4] * 9
    assert ld.common_blocks([1, 2, 3, 4, 5, 6, 7, 8, 9], [6, 7, 8, 20, 1, 2, 3, 4, 5], words, 12) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert ld.common_blocks([1, 2, 3], [3, 2, 1], [4, 4, 4], 8) == []
    assert ld.common_blocks([1, 2, 3], [3, 2, 1], [9, 9, 9], 8) == [0, 1, 2]
    back = list(range(1, 30_000))
    assert ld.common_blocks(back, back[::-1], [1] * len(back), 2) == []


def common_runs(a, b, words, least):
    """Every run of lines of ``a`` that stands in ``b``, tried one by one."""
    out = set()
    for i in range(len(a)):
        for at in range(len(b)):
            n = 0
            while i + n < len(a) and at + n < len(b) and a[i + n] == b[at + n]:
                n += 1
            if n and sum(words[i : i + n]) >= least:
                out.update(range(i, i + n))
    return sorted(out)


def test_blocks_against_all_runs():
    rng = random.Random(21)
    found = 0
    for _ in range(3000):
        size = [0, *(rng.randrange(1, 14) for _ in range(7))]
        a = [rng.randrange(8) for _ in range(rng.randrange(14))]
        b = [rng.randrange(8) for _ in range(rng.randrange(14))]
        if rng.random() < 0.5 and a:
            i, at = rng.randrange(len(a)), rng.randrange(len(b) + 1)
            b[at:at] = a[i : i + 5]
        words = [size[x] for x in a]
        found += bool(want := common_runs(a, b, words, 20))
        assert ld.common_blocks(a, b, words, 20) == want
    assert found > 500


def test_moved_block_whose_first_line_stands_twice():
    # 'P1 X P1 P2 Z', and P1 P2 behind a longer aligned part.
    assert ld.common_blocks([10, 11, 12, 1, 2], [1, 9, 1, 2, 8, 10, 11, 12], [12] * 5, 20) == [0, 1, 2, 3, 4]


def plain(rows, least):
    """Text per (doc_id, text), every document against all earlier ones."""
    texts = sorted({(-(1 << 63) if d is None else d, t) for d, t in rows if t is not None})
    out = {}
    for at, (doc, text) in enumerate(texts):
        lines = text.split("\n")
        keys = [x.strip() or None for x in lines]
        gone = set()
        for _, other in texts[:at]:
            theirs = [x.strip() or None for x in other.split("\n")]
            if set(keys) & set(theirs) - {None}:
                gone |= set(ld.common_blocks([hash(k) if k else 0 for k in keys], [hash(k) if k else 0 for k in theirs], [len(x.split()) for x in lines], least))
        out[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def fixture_rows():
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rows = []
    for doc in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"own {doc} {i} " + "w " * rng.randrange(9) for i in range(12)]
        start = rng.randrange(50)
        lines[4:4] = pool[start : start + rng.randrange(6)]
        rows.append((doc, "\n".join(lines)))
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, rows[3][1]), (62, ""), (63, None), (64, "\n\n \n"), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("rare", [1000])
def test_documents_against_all_pairs(spark, rare):
    rows = fixture_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, deleted string, id int")
    got = ld.dedup_lines(docs, rare=rare, least=8).collect()
    want = plain(rows, 8)
    changed = 0
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(None if t is None else want[-(1 << 63) if d is None else d, t])
    for d, kept in by_id.items():
        assert sorted(map(str, kept)) == sorted(str(r.text) for r in got if r.doc_id == d)
    for r in got:
        changed += r["__changed"]
    assert changed > 10 and len(got) == len(rows)


def test_common_lines_pair_with_the_earliest(spark):
    block = "\n".join(f"shared line {i} of the passage that all of them hold" for i in range(6))
    rows = [(d, f"before {d}\n{block}\nafter {d}") for d in range(40)] + [(99, "nothing of the kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got[0] == rows[0][1] and got[99] == rows[-1][1]
    assert all(got[d] == f"before {d}\nafter {d}" for d in range(1, 40))


def blocks_of_common_lines():
    """Every line is common and its earliest holder holds it alone or in another order."""
    rng = random.Random(5)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.choice([3, 7, 12]))) for i in range(24)]
    rows = [(i, f"own {i}\n{line}\nalone {i}") for i, line in enumerate(pool)]
    for doc in range(100, 400):
        lines = [f"own {doc}"]
        for k in range(3):
            start = rng.randrange(24)
            lines += [*(pool * 2)[start : start + rng.randrange(1, 5)], *rng.choice([[], [""], ["", ""]]), f"own {doc} {k}"]
        rows.append((doc, "\n".join(lines)))
    return rows


def all_pairs(rows):
    """Text per doc_id without any run of a block's words that an earlier document holds."""
    out = {}
    for at, (doc, text) in enumerate(rows):
        lines = text.split("\n")
        words = [len(x.split()) for x in lines]
        gone = {i for _, other in rows[:at] for i in common_runs(lines, other.split("\n"), words, ld.BLOCK_WORDS)}
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_blocks_of_common_lines_against_all_pairs(spark):
    rows = blocks_of_common_lines()
    counts = {}
    for _, text in rows:
        for x in set(text.split("\n")):
            counts[x] = counts.get(x, 0) + 1
    assert min(n for x, n in counts.items() if x.startswith("w")) > ld.RARE
    want = all_pairs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == want
    assert sum(got[d] != t for d, t in rows) > 100


def test_block_whose_lines_begin_elsewhere(spark):
    one, two = ("first line of ten words that no block makes alone", "second line of ten words that no block makes alone too")
    rows = [(d, f"a{d}\n{one}\nb{d}") for d in range(10)] + [(d, f"a{d}\n{two}\nb{d}") for d in range(10, 20)]
    rows += [(d, f"a{d}\n{one}\n{two}\nb{d}") for d in (50, 60, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r["__changed"]) for r in ld.dedup_lines(docs).collect()}
    assert got[50] == (rows[20][1], False)
    assert got[60] == ("a60\nb60", True) and got[70] == ("a70\nb70", True)


def test_shortest_runs_cover_every_block():
    rng = random.Random(9)
    for _ in range(300):
        hashes = [rng.randrange(6) for _ in range(rng.randrange(16))]
        words = [3 * x for x in hashes]
        runs = ld.shortest_runs(hashes, words, {1, 2, 3, 5}, 10)
        by = {}
        for run, digest in zip(runs, ld.run_digests(hashes, runs), strict=True):
            assert by.setdefault(digest, hashes[run[0] : run[1] + 1]) == hashes[run[0] : run[1] + 1]
            assert sum(words[run[0] : run[1] + 1]) >= 10 and 4 not in hashes[run[0] : run[1] + 1]
        for i in range(len(hashes)):
            for j in range(i, len(hashes)):
                if 4 not in hashes[i : j + 1] and sum(words[i : j + 1]) >= 10:
                    inside = [r for r in runs if i <= r[0] and r[1] <= j]
                    assert set(range(i, j + 1)) == {x for p, q in inside for x in range(p, q + 1)}


def test_empty_table_and_query(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(docs).count() == 0
    found = ld.op2_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert found
    for r in found:
        lines = texts[r.doc_id].split("\n")
        assert len(lines) - r.n_deleted == (len(r.text.split("\n")) if r.text or r.n_deleted < len(lines) else 0)
        assert all(e < r.doc_id for e in r.earlier_ids)
