"""License scans against SQL and a plain version."""

from __future__ import annotations

import re

import pytest

from hirelake.llm import licenses as li
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(li.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = [
        (at, label)
        for phrase, label in li.PHRASES.items()
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    base = sorted({label for _, label in starts})
    more, share = set(), 0.0
    for at in range(-li.WINDOW // 2, len(words), li.WINDOW // 2):
        block = set(words[max(at, 0) : at + li.WINDOW])
        for label, notice in li.TEMPLATES.items():
            t = li.Template.of(label, notice)
            n = len(block & set(t.words))
            if n >= t.enough:
                more.add(label)
                share = max(share, n / len(t.words))
    at = [a for a, _ in starts]
    return (
        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base),
        ",".join(sorted({*base, *more})), 1.0 if at else share,
    )


TEXTS = [
    None,
    "",
    " .,; ",
    "MIT License",
    "the mit license, mit license; MIT-License! mit licenses",
    "Apache License and GNU General Public License (cc by) é cc\nBY",
    "x " * 45 + li.TEMPLATES["bsd"].upper().replace(" ", ",\n") + " y" * 80,
    "word " * 31 + li.TEMPLATES["isc"] + " tail",
    " ".join(li.TEMPLATES["mit"].split()[::-1]) + " mit",
    " ".join(li.TEMPLATES["gpl"].split()[:-9]),
    "free software public domain released",
    "öffentlich " * 40_000 + "mit license",
]


def test_texts_against_plain_version(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "c"), (None, TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    got = sorted((tuple(r) for r in li.scan(docs, ["doc_id"]).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    assert sum(r[-1] > 0 for r in got) >= 8
    assert li.scan(docs.limit(0), ["doc_id"]).count() == 0


def test_query_matches_sql(spark):
    got = li.op3_license_scan(spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).execute(li._sql()).df()) is None
    assert (got.n_base > 0).any()


def test_plan_is_native(spark):
    plan = li.op3_license_scan(spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_template_must_fit_a_window():
    with pytest.raises(ValueError, match="half a window"):
        li.Template.of("long", "word " * (li.WINDOW // 2 + 1))
