"""The pipeline against a plain version of its stages, and its parts."""

from __future__ import annotations

import public_tokenizers
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from hirelake.llm import bpe, decontaminate, langid, line_dedup
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_fingerprint, plain_groups

FOLDER = "/root/testdata/sf0.001"


def plain_pipeline(docs, items, dictionaries):
    """{doc_id: text} that remain; doc ids are distinct, texts not null."""
    classify = langid.Classifier(dictionaries).predict
    now = {d: t for d, t in docs.items() if classify(t)[1] >= langid.MARGIN and classify(t)[0] != "und"}
    cut = plain_lines([(d, t) for d, t in now.items()], line_dedup.BLOCK_WORDS)
    now = {d: cut[d, t] for d, t in now.items() if cut[d, t].strip()}
    rows = [(d, plain_fingerprint(t)) for d, t in now.items()]
    now = {d: now[d] for (d, _), group in zip(rows, plain_groups(rows), strict=True) if d == group}
    index = decontaminate.Index.build(items)
    clean = {}
    for d, t in now.items():
        points = decontaminate._points(decontaminate.normalise(t))
        found = False
        for item, first in zip(*index.regions(points), strict=True):
            k = int(index.edits[item])
            cost, _ = decontaminate.align([index.points[item]], [points], first.reshape(1), 2 * (k + 1))
            found |= cost[0] <= k
        if not found:
            clean[d] = t
    return clean


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = plain_pipeline({r.doc_id: r.text for r in docs.collect()}, items, langid.fit(docs))
    ranks = bpe.load_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in contract.queries()["pipeline"](spark, FOLDER).collect()}
    assert got == {d: truth.encode_ordinary(t) for d, t in want.items()}
    assert 0 < len(want) < docs.count()


def test_stages_on_unusual_rows(spark):
    text = "The river ran past the old house and the people of the town walked along it every evening"
    rows = [
        (1, f"{text}\nfirst", "en", "a", 10, "z"),
        (1, f"{text}\nfirst", "en", "a", 10, "z"),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, None),
        (None, f"{text} too", "fr", None, 3, None),
        (4, " \n\t ", "de", "b", 4, None),
        (5, "x", "en", None, 1, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "tokens":
            assert out.columns == docs.columns, name
        assert out.count() >= 0
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = corpus_pipeline.near_copies(spark, docs, FOLDER)
    assert sorted(str(r.doc_id) for r in kept.collect()) in (["1", "2", "5", "None"], ["1", "2", "5"])


def test_registered():
    import hirelake.llm as llm

    names = llm.queries()
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")], n
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "tokens"]
    assert set(names) | {"pipeline"} <= set(contract.queries())
    assert set(llm.oracle_sql()) <= set(contract.oracle_sql())
