"""Chat formatting: round trips, the tree of a pack, the query against SQL."""

from __future__ import annotations

import random

import pytest

from hirelake.llm import chat
from tests.check_queries import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    "text", ["", "\\", "\\n", "\\l<", "<", "</turn>\n<turn>assistant\nhi", chat.TRAP, "a\nb\\<c\\\\n", "é" * 3, "x" * 300_000]
)
def test_turns_can_be_read_back(text):
    for role in ("user", "assistant", "sys\ntem", "<turn>", "\\n", ""):
        formatted, start, stop = chat.write_turn(role, text)
        assert chat.read_turn(formatted) == (role, text)
        assert formatted.count("<") == 2
        assert chat.unescape(formatted[start:stop]) == (text if role == "assistant" else "")


def rows():
    rng = random.Random(6)
    out = []
    for conv in range(80):
        turns = [("user", rng.choice(["hello", "hi\n", "<turn>"]))]
        for at in range(rng.randrange(5)):
            turns.append((rng.choice(["assistant", "user"]), rng.choice(["yes", "no </turn>", "\\", ""])))
        out += [(conv, at, role, text) for at, (role, text) in enumerate(turns)]
    out += [(200, 0, None, None), (201, None, "user", "late"), (201, 1, "user", "x"), (None, 0, "assistant", "lost")]
    out += [(202, 5, "assistant", "twice")] * 2 + [(203, 0, "assistant", "long " * 2000)]
    rng.shuffle(out)
    return out


def plain(given):
    by = {}
    for conv, turn, role, text in given:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(role, text) for _, _, role, text in sorted(turns)] for conv, turns in by.items()}


@pytest.mark.parametrize(("tokens", "most"), [(chat.PACK_TOKENS, chat.PACK_CONVERSATIONS), (400, 1024), (4000, 3)])
def test_packs(spark, tokens, most):
    given = rows()
    frame = spark.createDataFrame(given, SCHEMA).selectExpr("*", "'x' as path", "1 as nodes")
    packs = chat.pack(frame, tokens, most).collect()
    want, seen = plain(given), []
    for p in packs:
        assert len(p.leaves) == 1 or (len(p.text) <= tokens and len(p.leaves) <= most)
        assert [n.start for n in p.nodes] == [sum(m.length for m in p.nodes[:i]) for i in range(len(p.nodes))]
        for i, n in enumerate(p.nodes):
            above = [] if n.parent < 0 else [*p.nodes[n.parent].attends, (p.nodes[n.parent].start, p.nodes[n.parent].start + p.nodes[n.parent].length)]
            assert n.parent < i and [tuple(a) for a in n.attends] == [tuple(a) for a in above]
            assert n.position == sum(stop - start for start, stop in above)
        # No two children of a node are equal: each shared prefix stands once.
        texts = [(n.parent, p.text[n.start : n.start + n.length]) for n in p.nodes]
        assert len(set(texts)) == len(texts)
        for leaf in p.leaves:
            n = p.nodes[leaf.node]
            parts = [*[tuple(a) for a in n.attends], (n.start, n.start + n.length)]
            assert [chat.read_turn(p.text[s:e]) for s, e in parts] == want[leaf.conv_id]
            seen.append(leaf.conv_id)
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_read_back(spark):
    import hashlib

    given = rows()
    want = plain(given)
    for r in chat.read_back(chat.pack(spark.createDataFrame(given, SCHEMA), 1000, 7)).collect():
        turns = want.pop(r.conv_id)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.write_turn(a, b)[0]) for a, b in turns)
    assert not want


def test_merged_intervals_hold_the_same_tokens(spark):
    for p in chat.pack(spark.createDataFrame(rows(), SCHEMA), 4000, 9).collect():
        for n, m in zip(p.nodes, p.merged, strict=True):
            assert [x for a in n.attends for x in range(*a)] == [x for a in m.attends for x in range(*a)]
            assert all(a.stop < b.start for a, b in zip(m.attends, m.attends[1:], strict=False))


@pytest.mark.parametrize("conv", ["7L", "NULL"])
def test_one_conversation_of_100_000_turns(spark, conv):
    import hashlib

    n = 100_000
    given = spark.range(n).selectExpr(
        f"CAST({conv} AS BIGINT) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('say ', id) AS text"
    )
    said = [("assistant" if i % 2 else "user", f"say {i}") for i in range(n)]
    under = "".join(text for role, text in said if role == "assistant")
    for packs in (chat.trees(given), chat.pack(given)):
        (r,) = chat.read_back(packs).collect()
        assert (r.conv_id, r.n_turns, r.loss_chars) == (None if conv == "NULL" else 7, n, len(under))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.write_turn(a, b)[0]) for a, b in said)
    assert chat.trees(given).selectExpr("aggregate(nodes, 0, (s, n) -> s + size(n.attends)) AS n").first().n == n - 1


def test_empty_table(spark):
    assert chat.read_back(chat.pack(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = chat.op8_chat_format(spark, folder).toPandas()
    assert compare(got, connect(folder).execute(chat.SQL).df()) is None
    assert (got.conv_id == -7).sum() == 1
