"""Personal data: plain spans against the patterns as written, disguises by hand."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from hirelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    match kind:
        case "ip":
            return all(int(p) <= 255 for p in text.split("."))
        case "card":
            total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(digits[::-1]))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        case "phone":
            return 9 <= len(digits) <= 15
    return True


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PATTERNS.items()}


def test_plain_spans_of_random_strings():
    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice("a1.2@ -+().@5é%0.") for _ in range(rng.randrange(60)))
        assert pii.spans(text)[0] == plain(text), text
    for _ in range(400):
        card = "".join(rng.choice("0123456789") for _ in range(rng.randrange(12, 21)))
        assert pii.cards(card) == plain(card)["card"]


def test_plain_spans_of_documents(spark):
    got = pii.op7_pii(spark, "/root/testdata/sf0.01")
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {r.doc_id: r for r in got.collect()}
    seen = 0
    for doc in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = plain(doc.text)
        text = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k])
        r = got[doc.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values()))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        seen += len(text) > 0
    assert seen > 20


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to ana.diaz [at] example [dot] org today", "email", "ana.diaz [at] example [dot] org"),
        ("write to ana at example dot co dot uk, or", "email", "ana at example dot co dot uk"),
        ("write to ana(at)example.org!", "email", "ana(at)example.org"),
        ("mail аnа@ехample.org", "email", "аnа@ехample.org"),
        ("mail ana＠example．org", "email", "ana＠example．org"),
        ("mail ana\u200b@\u200bexample.org", "email", "ana\u200b@\u200bexample.org"),
        ("call plus four nine one five two three four five six seven now", "phone", "plus four nine one five two three four five six seven"),
        ("call ＋４９ １５２ ３４５６７８９", "phone", "＋４９ １５２ ３４５６７８９"),
        ("pay four one one one one one one one one one one one one one one one soon", "card",
         "four one one one one one one one one one one one one one one one"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
    ],
)
def test_disguises(text, kind, part):
    _, added = pii.spans("Überall é " + text)
    assert [("Überall é " + text)[s:e] for s, e in added[kind]] == [part]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("host one two seven dot zero dot zero dot one up", "ip", "one two seven dot zero dot zero dot one"),
        ("host one dot two dot three dot four", "ip", "one dot two dot three dot four"),
        ("host 192 dot 168 dot 1 dot 10 up", "ip", "192 dot 168 dot 1 dot 10"),
        ("port 8080 10 POINT 0 Dot zero dot 1 5 times", "ip", "10 POINT 0 Dot zero dot 1"),
        ("host one nine two dot one six eight dot zero dot 12 up", "ip", "one nine two dot one six eight dot zero dot 12"),
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("mail john dot q dot smith [at] example.com now", "email", "john dot q dot smith [at] example.com"),
        ("a dot b at c dot de, d dot e(at)f.gh", "email", ["a dot b at c dot de", "d dot e(at)f.gh"]),
    ],
)
def test_spoken_dots(text, kind, part):
    _, added = pii.spans("Überall é " + text)
    assert [("Überall é " + text)[s:e] for s, e in added[kind]] == ([part] if isinstance(part, str) else part)


@pytest.mark.parametrize(
    "text",
    ["one.two.three.four", "three point one four", "version 1 dot 2 dot 3", "400 dot 1 dot 1 dot 1", "noon dot dot dot at home", "a dot b met at noon"],
)
def test_other_dots_gain_nothing(text):
    assert not any(pii.spans(text)[1].values())


def test_spoken_dots_take_linear_time():
    start = time.perf_counter()
    for unit in ("1 dot ", "one dot ", "one, ", "a dot b at c dot de ", "a dot ", "1 ", "1  dot"):
        pii.spans(unit * (200_000 // len(unit)) + "at c dot de")
    assert time.perf_counter() - start < 40


@pytest.mark.parametrize(
    "text",
    [None, "", "look at example.com", "we met at noon dot dot dot", "one two three", "at home (at last) we dot the i", "un deux — trois",
     "ana@example.org and 10.0.0.1 at peace"],
)
def test_clean_texts_gain_nothing(text):
    assert not any(pii.spans(text)[1].values())


def test_blanks_before_a_sign_go_with_it():
    for blanks in ("", " ", "\t  ", " " * 50):
        text = f"write to ana{blanks}[at]{blanks}example{blanks}(dot){blanks}org now"
        assert pii.spans(text)[1]["email"] == [(9, text.index("org") + 3)]


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    for unit in ("a", "7", "1 ", "@", "a@", "1.", "+1 (", "one ", " at ", "[at]", "é", "\u200b", "x dot ", "a at b ", " ", "\t"):
        pii.spans(unit * (200_000 // len(unit)))
    for text in ("a%sb", "one%stwo", "one%s", "plus%s1", "a [%sat", "a at b%sdot", "a%s[at] b.de"):
        pii.spans(text % (" " * 200_000))
    assert time.perf_counter() - start < 40


def test_null_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x@y.zz", "b")], "doc_id long, text string, spans string")
    got = pii.find_personal_data(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, "email:0:6"), (1, ""), (1, "")]
    assert pii.find_personal_data(docs.limit(0), ["doc_id"]).count() == 0
