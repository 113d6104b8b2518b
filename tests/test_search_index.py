"""The search index against scans, over days of changes."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from hirelake.operators import search
from hirelake.operators.search_index import SearchIndex, grams, wanted_grams
from hirelake.session import cut_lineage

AS_OF = "2026-10-06 12:00:00"
SCHEMA = (
    "id bigint, title string, company string, description string, job_family string, job_subfamily string, skills array<string>, "
    "related_roles array<string>, location string, ai_locations array<struct<city:string,state:string,state_code:string,country_code:string,remote:boolean>>"
)
WORDS = ["Brücke", "bridge", "Ferry", "SQL", "C++", "naïve", "data", "über", "n", "Ops", "漢字", "welder"]


def job(rng, ident):
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randrange(n)))
    places = [(rng.choice(["Duluth", "Austin"]), "", rng.choice(["MN", "TX"]), "US", rng.random() < 0.2) for _ in range(rng.randrange(3))]
    return (ident, text(3) or None, text(2), text(9), text(2), None, rng.choices(WORDS, k=rng.randrange(3)), rng.choice([None, [], ["Bridge lead"]]),
            rng.choice([None, "", "Lyon", "Austin, TX"]), rng.choice([None, places]))


def frame(spark, jobs):
    return spark.createDataFrame(list(jobs), SCHEMA).repartition(3)


def cutter(tmp_path):
    return lambda df: cut_lineage(df, f"file://{tmp_path}/cut")


NEEDLES = [("bridge", ""), ("RÜC", ""), ("a", ""), ("", "tx"), ("字", ""), ("sq", "austin"), ("data f", ""), ("zzz", ""), ("", "Lyon"), ("", ""), (" C++ ", "")]


def check(spark, index, jobs, needles=NEEDLES):
    every = frame(spark, jobs.values())
    for query, place in needles:
        got = sorted(r["id"] for r in index.search(query, place).select("id").collect())
        want = sorted(r["id"] for r in search.search(every, AS_OF, query, place).select("id").collect())
        assert got == want, (query, place)


def test_searches_over_days_of_changes(spark, tmp_path):
    rng = random.Random(1)
    index = SearchIndex(spark, "idx_days", f"file://{tmp_path}/index", SCHEMA, segment=16, buckets=8).create()
    assert index.search("bridge").collect() == []
    cut = cutter(tmp_path)
    jobs = {i: job(rng, i) for i in range(60)}
    index.update(frame(spark, jobs.values()), cut=cut)
    check(spark, index, jobs)
    # Some change, some come, some go; another day only removes.
    changed = {i: job(rng, i) for i in [*range(0, 60, 9), *range(60, 75)]}
    gone = [5, 6, 60_000]
    index.update(frame(spark, changed.values()), spark.createDataFrame([(i,) for i in gone], "id bigint"), cut)
    jobs = {i: j for i, j in (jobs | changed).items() if i not in gone}
    check(spark, index, jobs)
    index.update(frame(spark, []), spark.createDataFrame([(7,)], "id bigint"), cut)
    del jobs[7]
    assert sorted(r["id"] for r in index.search().select("id").collect()) == sorted(jobs)
    (cost,) = index.cost("字").collect()
    assert cost["segments_read"] == cost["segments"]  # one character reads all
    (cost,) = index.cost("zzz").collect()
    assert (cost["candidates"], cost["segments_read"], cost["bytes_read"]) == (0, 0, 0) and cost["bytes"] > 0


def test_rare_words_read_few_segments_and_interrupted_updates_leave_no_trace(spark, tmp_path):
    index = SearchIndex(spark, "idx_rare", f"file://{tmp_path}/index", SCHEMA, segment=16, buckets=8).create()
    cut = cutter(tmp_path)
    rng = random.Random(2)
    jobs = {i: job(rng, i) for i in range(200)}
    jobs[77] = (77, "Lighthouse keeper", *jobs[77][2:])
    index.update(frame(spark, jobs.values()).coalesce(1), cut=cut)
    (cost,) = index.cost("lighthouse").collect()
    assert (cost["candidates"], cost["segments_read"], cost["segments"]) == (1, 1, 13) and 0 < cost["bytes_read"] < cost["bytes"] / 4
    calls = []

    def lost(df):
        calls.append(1)
        if len(calls) == 4:  # after jobs, grams and numbers gone are written
            raise RuntimeError("lost")
        return cut(df)

    changed = {77: job(rng, 77), 500: job(rng, 500)}
    with pytest.raises(RuntimeError):
        index.update(frame(spark, changed.values()), cut=lost)
    check(spark, index, jobs, NEEDLES[:2])
    index.update(frame(spark, changed.values()), cut=cut)
    check(spark, index, jobs | changed, NEEDLES[:5])


def test_a_shared_text_is_stored_as_bits_of_its_jobs(spark, tmp_path):
    index = SearchIndex(spark, "idx_bits", f"file://{tmp_path}/index", SCHEMA, buckets=1).create()
    rows = spark.range(5_000).select("id", *[F.lit(v).alias(c) for c, v in (("title", "Senior bridge engineer of the northern crossings"), ("description", "Keeps old ferries running"))])
    ddl = [column.split(" ", 1) for column in SCHEMA.split(", ")]
    index.update(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in ddl]), cut=cutter(tmp_path))
    assert index.search("ridge eng").count() == 5_000 and index.candidates("ferries r").distinct().count() == 5_000
    # 130 grams; 12 bits a job and gram, as a list of places needs, would be 900 kB.
    assert sum(f.stat().st_size for f in (tmp_path / "index" / "grams").rglob("*.parquet")) < 100_000


def test_grams(spark):
    texts = [("Abc",), ("a",), ("",), ("é🙂x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(grams(F.col("t"))).collect()]
    assert got == [["ab", "bc", "abc"], [], [], ["é🙂", "🙂x", "é🙂x"], []]
    start = time.perf_counter()
    long = spark.range(1).select(F.size(grams(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.hex(i)), ""))))
    assert long.first()[0] > 4000 and time.perf_counter() - start < 20
    assert wanted_grams(" AbCd ") == ["abc", "bcd"] and wanted_grams("tx") == ["tx"] and wanted_grams("x") == [] == wanted_grams("")
