"""Operators end to end on small tables: files, crawls, enrichment, publication, streams."""

from __future__ import annotations

import json
import random
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hirelake.operators import companies as comp, enrich, facet_bitmaps, inventory as inv, lifecycle as life, runs, search, snapshots as snap, trends
from hirelake.operators.hiring_stats import hiring_stats
from hirelake.operators.quality import violations
from hirelake.plans import daily, queries
from hirelake.plans.search_queries import client
from hirelake.plans.standins import ORDERS_AS_OF
from hirelake.plans.text_queries import first_crawl
from hirelake.session import cut_lineage
from hirelake.sources import inventory as src, payloads, store
from hirelake.sources.payloads import with_content_hash
from hirelake.operators.lifecycle import JOB_SCHEMA
from hirelake.streaming.crawl_stream import (
    MANIFEST_SCHEMA,
    POSTING_SCHEMA,
    Folders,
    counts_table,
    current_state,
    daily_event_counts,
    keyed_sink,
    start_lifecycle,
)

NOW = "2026-10-06 12:00:00"
LATER = "2026-10-07 12:00:00"
GREENHOUSE = {
    "id": 101, "title": "Bridge Inspector", "company_name": "Harbor & Mill", "location": {"name": "Duluth, MN"},
    "first_published": "2026-10-06T03:00:00Z", "content": "&lt;p&gt;Walk every span twice a year.&lt;/p&gt;",
    "absolute_url": "https://harbormill.test/openings/101", "departments": [{"name": "Structures"}],
    "offices": [{"name": "Lakeside", "location": "Duluth, MN"}],
}
LEVER = {
    "id": "ferry-7", "text": "Ferry Dispatcher", "categories": {"location": "Remote", "commitment": "Full-time"},
    "workplaceType": "hybrid", "descriptionPlain": "Keep the boats on time.", "hostedUrl": "https://ferries.test/openings/7",
}


SCRATCH = tempfile.mkdtemp(prefix="hirelake-cut-")


def cut(df):
    return cut_lineage(df, SCRATCH)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def record(**fields):
    """An empty record of every key: nothing stated, confidence 0.9."""
    lists = ("skills", "domain_tags", "education_fields", "certifications", "locations", "offices")
    base = {k: [] if k in lists else "unknown" if k in enrich.ENUMS else None for k in enrich.RECORD_FIELDS}
    return json.dumps(base | {"confidence": 0.9} | fields)


# --- files ------------------------------------------------------------------


def test_candidate_files_merge(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(
        "\ufeffats_platform,canonical_url,company_name\n"
        "AshbyHQ, https://jobs.ashbyhq.com/quarry ,\nashby,https://jobs.ashbyhq.com/quarry/board,Quarry Two\n"
        "lever,no address,Z\n,https://jobs.lever.co/dune,W\n",
        encoding="utf-8",
    )
    table = spark.createDataFrame(
        [("ashbyhq", "quarry", "Quarry", "https://quarry.test/work"), ("workday", "dune.wd5/openings", "Dune", "u"), ("gem", "later-arrival", "Later Arrival", None), ("gem", " ", "Nameless", None)],
        "ats string, slug string, name string, career_url string",
    )
    table.write.parquet(str(tmp_path / "companies"))
    csv = src.read_candidate_csv(spark, str(path))
    rows = src.read_candidate_parquet(spark, str(tmp_path / "companies"))
    assert tuple(inv.feed_counts(csv).first()) == (4, 2)
    assert tuple(inv.feed_counts(rows).first()) == (4, 1)
    merged = inv.merge_candidates(csv, rows).orderBy("provider").collect()
    assert [(r["provider"], r["source_slug"]) for r in merged] == [("ashby", "quarry"), ("gem", "later-arrival"), ("workday", "dune.wd5/openings")]
    both = merged[0]
    assert (both["canonical_url"], both["company_name"], both["board_id"]) == ("https://jobs.ashbyhq.com/quarry", "Quarry", "quarry")
    assert both["in_csv"] and both["in_parquet"] and both["rows_merged"] == 3
    with pytest.raises(ValueError, match="company_name"):
        src.csv_candidates(csv.select(F.lit("a").alias("ats_platform"), F.lit("b").alias("canonical_url")))


def test_url_inventory_file_last_row_wins(spark, tmp_path):
    path = tmp_path / "urls.csv"
    path.write_text("canonical_url,ats_platform\nhttps://x.io/a,Lever\nhttps://x.io/a,lever\nhttps://y.io/b,Breezy HR\nbad,lever\n")
    rows = src.unique_inventory(src.read_url_inventory(spark, str(path))).orderBy("provider").collect()
    assert [(r["provider"], r["source_slug"][:4], r["board_id"]) for r in rows] == [("breezy", "url_", None), ("lever", "a", "a")]


# --- store ------------------------------------------------------------------


def test_figures_are_counted_while_rows_are_written(spark, tmp_path):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    schema = "outcome string, model string, input_tokens bigint, output_tokens bigint, thought_tokens bigint, cached_tokens bigint, total_tokens bigint, day int"
    rows = [(kind, None, n, 1, None, 0, n + 1, n % 3) for n, kind in enumerate(["completed", "failed", "stale", "skipped_non_us", "completed"] * 40)]
    for name, given, part in [("all", rows, None), ("days", rows, "day"), ("none", [], None)]:
        df = spark.createDataFrame(given, schema).repartition(4, "outcome")
        before = scheduler.numTotalJobs()
        store.append_rows(df, str(tmp_path / f"{name}-plain"), part)
        plain_jobs, before = scheduler.numTotalJobs() - before, scheduler.numTotalJobs()
        counted = store.append_counted(df, str(tmp_path / name), runs.enrichment_figures(), part)
        # Not one job more than the write alone.
        assert scheduler.numTotalJobs() - before == plain_jobs
        want = runs.enrichment_summary(df)
        assert counted.columns == want.columns and tuple(counted.first()) == tuple(want.first())
        assert spark.read.schema(schema).parquet(str(tmp_path / name)).count() == len(given)


def test_upsert_policies_and_publication(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, note string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, name string, note string")
    rows = store.upsert(old, new, ["id"], {"name": store.prefer_new, "note": store.prefer_old}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "x"), (2, "b", "n"), (3, "c", "m")]
    kept = store.upsert(old, new, ["id"], when=lambda o, n: o("name") == "zzz").orderBy("id").collect()
    assert [tuple(r) for r in kept] == [(1, "a", "x"), (2, "b", None), (3, "c", "m")]
    store.replace_table(old, "people")
    store.replace_table(store.upsert(spark.table("people"), new, ["id"]), "people")
    assert spark.table("people").count() == 3
    spark.sql("DROP TABLE people")
    days = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "d string, n int").selectExpr("CAST(d AS DATE) AS snapshot_date", "n")
    store.publish_days(days, str(tmp_path / "days"))
    store.publish_days(days.filter("n = 2").withColumn("n", F.lit(9)), str(tmp_path / "days"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 9]
    store.append_rows(days, str(tmp_path / "log"), "snapshot_date")
    store.append_rows(days, str(tmp_path / "log"), "snapshot_date")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


# --- crawl ------------------------------------------------------------------

SOURCES = "source_id bigint, status string, company_id string, last_attempt_at timestamp, last_crawled_at timestamp, last_success_at timestamp, last_failure_at timestamp, last_job_count bigint, consecutive_failures int, last_error string"
COMPANIES = "company_id string, name string, normalized_name string, slug string, website_domain string, tracking_started_at timestamp, created_at timestamp"


def crawl_day(spark, bodies, state, sources, companies, queue, as_of, run):
    boards = spark.createDataFrame(
        [(s, run, p, f"board{s}", json.dumps(b)) for s, p, b in bodies],
        "source_id bigint, crawl_run_id bigint, provider string, board string, body string",
    )
    crawls = boards.selectExpr("source_id", "crawl_run_id", f"TIMESTAMP '{as_of}' AS started_at")
    out = daily.crawl(boards, crawls, state, sources, companies, queue, as_of, cut=cut)
    names = ("jobs", "events", "versions", "queue", "sources", "per_source", "crawl_runs")
    return daily.CrawlOutput(life.CrawlResult(**{n: cut(getattr(out.result, n)) for n in names}), out.companies, out.quarantine)


@pytest.fixture(scope="module")
def two_days(spark):
    sources = spark.createDataFrame(
        [(1, "active", None, None, None, None, None, None, 2, None), (2, "active", None, None, None, None, None, None, 0, None), (3, "active", None, None, None, None, None, None, 2, None)],
        SOURCES,
    )
    bodies = [(1, "greenhouse", {"jobs": [GREENHOUSE, GREENHOUSE | {"id": 102}]}), (2, "lever", [LEVER]), (3, "ashby", {"oops": 1})]
    first = crawl_day(spark, bodies, empty(spark, life.JOB_SCHEMA), sources, empty(spark, COMPANIES), empty(spark, life.QUEUE_SCHEMA), NOW, 11)
    day1 = {n: getattr(first.result, n) for n in ("jobs", "events", "versions", "queue", "sources", "per_source")}
    changed = [(1, "greenhouse", {"jobs": [GREENHOUSE | {"title": "Chief Inspector", "first_published": "2026-10-07T03:00:00Z"}]}), (2, "lever", [LEVER])]
    queue = empty(spark, life.QUEUE_SCHEMA).unionByName(day1["queue"], allowMissingColumns=True)
    second = crawl_day(spark, changed, day1["jobs"], day1["sources"], first.companies, queue, LATER, 12)
    return first, day1, second


def test_first_crawl_is_baseline(two_days):
    first, day1, _ = two_days
    assert day1["jobs"].count() == 3 and first.quarantine.count() == 1
    events = day1["events"].collect()
    assert {e["event_type"] for e in events} == {"created"} and all("true" in e["metadata"] for e in events)
    assert {(q["reason"], q["priority"]) for q in day1["queue"].collect()} == {("bootstrap", 3)}
    statuses = {s["source_id"]: (s["status"], s["consecutive_failures"], s["last_job_count"]) for s in day1["sources"].collect()}
    assert statuses == {1: ("active", 0, 2), 2: ("active", 0, 1), 3: ("inactive", 3, None)}
    assert {c["name"] for c in first.companies.collect()} == {"Harbor & Mill", "board2"}
    linked = {s["source_id"] for s in day1["sources"].filter("company_id IS NOT NULL").collect()}
    assert linked == {1, 2}
    assert tuple(life.crawl_summary(day1["per_source"]).first()) == (3, 2, 1, 0, 3, 0, 0, 0)


def test_second_crawl_changes_and_removes(two_days):
    _, day1, second = two_days
    result = second.result
    assert sorted(e["event_type"] for e in result.events.collect()) == ["changed", "removed"]
    version = result.versions.collect()
    assert [v["title"] for v in version] == ["Bridge Inspector"]
    assert [(q["reason"], q["priority"]) for q in result.queue.collect()] == [("changed_job", 2)]
    jobs = {j["external_job_id"]: j for j in result.jobs.collect()}
    assert jobs["101"]["title"] == "Chief Inspector" and jobs["101"]["classification_status"] == "pending"
    assert not jobs["102"]["active"] and jobs["102"]["removed_at"] is not None
    lever = jobs["ferry-7"]
    # The first crawl had no earlier success, so bounds are only known from the second on.
    assert lever["observed_new_after"] == datetime(2026, 10, 6, 12) and lever["observed_new_before"] == datetime(2026, 10, 7, 12)
    old, new = (df.filter("active").count() for df in (day1["jobs"], result.jobs))
    kinds = [e["event_type"] for e in result.events.collect()]
    assert new == old + kinds.count("created") + kinds.count("reactivated") - kinds.count("removed")


def test_crawl_replay_is_idempotent(spark, two_days):
    first, day1, second = two_days
    jobs = second.result.jobs
    again = crawl_day(
        spark,
        [(1, "greenhouse", {"jobs": [GREENHOUSE | {"title": "Chief Inspector", "first_published": "2026-10-07T03:00:00Z"}]}), (2, "lever", [LEVER])],
        jobs, second.result.sources, second.companies, second.result.queue, LATER, 13,
    )
    assert again.result.events.isEmpty() and again.result.versions.isEmpty() and again.result.queue.isEmpty()
    assert again.companies.count() == second.companies.count()


def test_reactivation_and_blocked_removal(spark, two_days):
    _, day1, second = two_days
    sources = second.result.sources.withColumn("last_job_count", F.lit(100).cast("bigint"))
    boards = [(1, "greenhouse", {"jobs": [GREENHOUSE | {"id": 102}]})]
    third = crawl_day(spark, boards, second.result.jobs, sources, second.companies, second.result.queue, LATER, 14).result
    kinds = {e["event_type"] for e in third.events.collect()}
    assert kinds == {"reactivated"}  # 101 is missing, but a drop from 100 jobs to 1 blocks removal
    after = {s["source_id"]: s["last_job_count"] for s in third.sources.collect()}
    assert after[1] == 100 and third.per_source.filter("anomaly LIKE 'mass-drop%'").count() == 1


def test_repeated_external_id_keeps_the_last_posting(spark):
    posts = [GREENHOUSE, GREENHOUSE | {"title": "Second"}]
    sources = spark.createDataFrame([(1, "active", None, None, None, None, None, None, 0, None)], SOURCES)
    out = crawl_day(spark, [(1, "greenhouse", {"jobs": posts})], empty(spark, life.JOB_SCHEMA), sources, empty(spark, COMPANIES), empty(spark, life.QUEUE_SCHEMA), NOW, 1)
    assert [j["title"] for j in out.result.jobs.collect()] == ["Second"]
    assert out.result.per_source.first()["job_count"] == 2


def test_content_hash_is_stable_and_sensitive(spark):
    rows = spark.createDataFrame(
        [("lever", "T", "C", "L", None, None, "Build", "{}"), ("lever", "T", "C", "L", None, None, "Build", "{}"), ("lever", "T", "C", "L", None, None, "Other", "{}"), ("lever", "T", "C", "L", "", None, "Build", "{}")],
        "provider string, title string, company string, location string, employment_type string, workplace_type string, description_text string, raw_payload string",
    )
    hashes = [r["content_hash"] for r in with_content_hash(rows).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 3


def test_slug_collisions(spark):
    existing = spark.createDataFrame([("1", "Acme", "acme", "acme", None, None, None)], COMPANIES)
    names = spark.createDataFrame([("A.C.M.E",), ("Acme!",), ("ACME",), ("New Co",), ("new  co",), ("New-Co",), (" ",), (None,)], "name string")
    added = comp.missing_companies(existing, names, NOW).collect()
    slugs = {r["normalized_name"]: r["slug"] for r in added}
    assert set(slugs) == {"a.c.m.e", "acme!", "new co", "new-co"}
    assert slugs["new co"] == "new-co" and slugs["new-co"].startswith("new-co-") and slugs["acme!"].startswith("acme-")
    assert len(set(slugs.values())) == 4
    grown = comp.ensure_companies(existing, names, NOW)
    assert grown.filter("company_id = '1' AND tracking_started_at IS NOT NULL").count() == 1 and grown.count() == 5


# --- enrichment -------------------------------------------------------------


def test_record_validation_and_merge(spark):
    skills = [{"name": "JS", "requirement": "mentioned"}, {"name": "javascript", "requirement": "required"}, {"name": " JAVASCRIPT ", "requirement": "preferred"}, {"name": "Go", "requirement": "mentioned"}]
    certifications = [{"name": "PMP", "requirement": "preferred"}, {"name": "pmp", "requirement": "required"}]
    texts = [
        record(skills=skills, certifications=certifications, domain_tags=[" a  b ", "a b", ""]),
        '{"confidence": 0.9}', record(extra=1), record(seniority="boss"), record(salary_min=5, salary_max=1),
        record(years_experience_min=81), record(confidence=1.2), record(skills=[{"name": "required", "requirement": "required"}]),
        record(skills=[{"name": "x", "requirement": "maybe"}]), record(locations=[{"city": "Austin"}]), record(offices=None), "oops",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, data string")
    valid, rejected = enrich.validate_records(df)
    kept = valid.collect()
    assert [r["id"] for r in kept] == [0]
    rec = kept[0]["record"]
    assert [tuple(s) for s in rec["skills"]] == [("JavaScript", "required"), ("Go", "mentioned")]
    assert [tuple(c) for c in rec["certifications"]] == [("pmp", "required")]
    assert rec["domain_tags"] == ["a b"]
    errors = {r["id"]: r["errors"] for r in rejected.collect()}
    assert set(errors) == set(range(1, 12)) and errors[2] == ["extra_keys"] and errors[4] == ["salary_range"]


def test_records_of_the_wrong_shape_are_rejected(spark):
    place = {"city": "Oslo", "state": None, "state_code": None, "country": None, "country_code": None}
    bad = {
        "skills_text": record(skills=["Rust"]), "skills_mixed": record(skills=[{"name": "Go", "requirement": "required"}, "Rust"]),
        "skills_null": record(skills=[None]), "skills_number": record(skills=[{"name": 5, "requirement": "required"}]),
        "skills_key": record(skills=[{"name": "Go", "requirement": "required", "level": 1}]),
        "places_text": record(locations=["x"]), "places_null": record(locations=[place, None]), "places_key": record(locations=[place, {"city": "x"}]),
        "title_number": record(standardized_title=5), "title_object": record(standardized_title={"a": 1}),
        "tags_mixed": record(domain_tags=[1, {"a": 2}]), "tags_null": record(domain_tags=["a", None]), "list_object": record(offices={"a": 1}),
        "years_half": record(years_experience_min=3.5), "years_text": record(years_experience_min="3"), "flag": record(work_authorization_required="yes"),
        "certificate": record(certifications=[{"name": "", "requirement": "required"}]), "array": "[1]", "number": "7", "null": "null",
    }
    good = {
        "whole_years": record(years_experience_min=3.0, years_experience_max=10), "place": record(locations=[place]),
        "many": record(domain_tags=["a"], skills=[{"name": "Go", "requirement": "required"}], salary_min=1, salary_max=2.5),
    }
    df = spark.createDataFrame(list((bad | good).items()), "id string, data string")
    valid, rejected = enrich.validate_records(df)
    kept = {r["id"]: r["record"] for r in valid.collect()}
    assert set(kept) == set(good)
    assert kept["whole_years"]["years_experience_min"] == 3 and kept["whole_years"]["years_experience_max"] == 10
    errors = {r["id"]: r["errors"] for r in rejected.collect()}
    assert set(errors) == set(bad)
    assert errors["skills_text"] == ["skills"] and errors["places_text"] == ["locations"] and errors["title_number"] == ["type"]
    assert errors["tags_mixed"] == ["item_type"] and errors["list_object"] == ["list"] and errors["years_half"] == ["type"]


def test_trusted_facts_survive(spark):
    raw = json.dumps({"location": {"name": "Paris, France"}, "offices": [{"name": "Paris HQ"}], "salaryRange": {"min": 90000, "max": 110000, "currency": "eur", "interval": "yearly"}})
    jobs = spark.createDataFrame(
        [(1, record(citizenship_requirement="U.S. citizen"), "greenhouse", "Paris, France", "FullTime", "Hybrid", raw, "Open role")],
        "job_id int, data string, provider string, location string, employment_type string, workplace_type string, raw_payload string, description_text string",
    )
    rec = enrich.merge_trusted_facts(enrich.validate_records(jobs)[0]).first()["record"]
    assert rec["locations"][0]["city"] == "Paris, France" and rec["offices"] == ["Paris HQ"]
    assert (rec["employment_type"], rec["workplace_type"]) == ("full_time", "hybrid")
    assert (rec["salary_min"], rec["salary_max"], rec["salary_currency"], rec["salary_period"]) == (90000, 110000, "EUR", "year")
    assert rec["citizenship_requirement"] is None


def test_stored_json_fills_only_missing_columns(spark):
    data = json.dumps({"seniority": "senior", "job_family": "", "required_skills": ["SQL"], "soft_skills": ["Talk"], "years_experience_min": "3", "salary_min": "10.5", "locations": [{"region": "Texas"}]})
    rows = spark.createDataFrame(
        [("mid", None, [], ["kept"], None, None, None, None, data), (None, None, None, [], 7, None, None, None, data), (None, None, None, None, None, None, None, None, "{}")],
        "seniority string, job_family string, required_skills array<string>, skills array<string>, years_experience_min int, salary_min double, state string, skill_count int, data string",
    )
    filled = [tuple(r)[:8] for r in enrich.backfill_columns(rows).collect()]
    assert filled[0] == ("mid", None, ["SQL"], ["kept"], 3, 10.5, "Texas", 1)
    assert filled[1] == ("senior", None, ["SQL"], ["SQL", "Talk"], 7, 10.5, "Texas", 2)
    assert filled[2] == (None, None, [], [], None, None, None, 0)


def test_deterministic_fields_and_version_2_keys(spark):
    raw = json.dumps({"salary_range": {"min": 1}, "payRange": {"min": 2}, "createdAt": 17, "publishedAt": None, "updatedAt": "2026-01-01"})
    rows = spark.createDataFrame([("Lever", "x1", raw), (None, "x2", None)], "provider string, external_job_id string, raw_payload string")
    first, second = enrich.deterministic_fields(rows).collect()
    assert json.loads(first["salary_json"]) == {"min": 1}
    assert first["employer_timestamps"] == {"createdAt": "17", "updatedAt": "2026-01-01"}
    assert tuple(first["ats_identifiers"]) == ("lever", "x1") and second["structured_context"]["locations"] == []
    old = dict.fromkeys(enrich.V2_KEYS) | {"surprise": 1}
    del old["benefits"]
    found = spark.createDataFrame([(json.dumps(old),)], "d string").select(enrich.key_differences(F.col("d"), "v2").alias("k")).first()["k"]
    assert (found["missing"], found["extra"]) == (["benefits"], ["surprise"])


def test_warning_crawls(spark):
    crawls = spark.createDataFrame([("w", None), ("", True), (None, False), ("", None)], "warning string, deactivation_skipped boolean")
    assert crawls.filter(runs.crawl_warned()).count() == 2


ENRICHMENTS = (
    "enrichment_id string, job_id string, content_hash string, schema_version string, created_at timestamp, data string, "
    "standardized_title string, seniority string, required_skills array<string>, preferred_skills array<string>, "
    f"locations array<{enrich.LOCATION}>, workplace_type string, domain_tags array<string>, skill_count int"
)


def test_enrichment_run_and_publication(spark, two_days):
    first, day1, _ = two_days
    queue = empty(spark, life.QUEUE_SCHEMA).unionByName(day1["queue"], allowMissingColumns=True)
    place = [{"city": "Duluth", "state": "Minnesota", "state_code": "MN", "country": "United States", "country_code": "US"}]
    good = record(
        standardized_title="Inspector", seniority="senior", workplace_type="hybrid", locations=place,
        skills=[{"name": "Python", "requirement": "required"}, {"name": "PostgreSQL", "requirement": "preferred"}, {"name": "Talk", "requirement": "mentioned"}],
    )
    ids = [r["queue_id"] for r in queue.orderBy("queue_id").collect()]
    assert len(ids) == 2
    extracted = spark.createDataFrame(
        [(ids[0], good, None, None, None, None), (ids[1], None, "busy", "RateLimit", True, 100.0)],
        "queue_id string, data string, error string, error_class string, retryable boolean, retry_after_seconds double",
    )
    out = daily.enrich_run(queue, day1["jobs"], extracted, empty(spark, ENRICHMENTS), NOW, budget=10, cut=cut)
    after = {r["queue_id"]: r for r in out.queue.collect()}
    assert after[ids[0]]["status"] == "completed" and after[ids[1]]["status"] == "pending"
    assert after[ids[1]]["next_attempt_at"] == datetime(2026, 10, 6, 12, 1, 40) and after[ids[1]]["attempts"] == 1
    jobs = cut(out.jobs)
    assert jobs.filter("classification_status = 'ready' AND is_us_job AND classified_content_hash = content_hash").count() == 1
    done = jobs.filter("classification_status = 'ready'").first()
    assert done["skills"] == ["Python", "PostgreSQL", "Talk"] and done["seniority"] == "senior" and done["classification_confidence"] == 0.9
    assert [(p["city"], p["remote"]) for p in done["ai_locations"]][0] == ("Duluth", False)
    assert jobs.filter("classification_status <> 'ready' AND skills IS NOT NULL").isEmpty()
    assert out.enrichments.count() == 1
    budgeted = daily.enrich_run(queue, day1["jobs"], extracted, empty(spark, ENRICHMENTS), NOW, budget=1, cut=cut)
    assert budgeted.decided.count() == 1
    published = daily.publish_day(first.companies, jobs, day1["events"], out.enrichments, "2026-10-06", NOW)
    counts = {(r["dimension"], r["name"]): r["count"] for r in published.histograms.collect()}
    assert counts == {
        ("role", "Inspector"): 1, ("skill", "Python"): 1, ("skill", "PostgreSQL"): 1, ("seniority", "senior"): 1,
        ("location", "Duluth, Minnesota, United States"): 1, ("location", "Duluth, MN"): 1, ("workplace", "hybrid"): 1,
    }
    activity = published.activity
    assert activity.count() == 2 and activity.agg(F.sum("new_jobs")).first()[0] == 0  # baseline jobs are not new
    assert published.stats.agg(F.sum("posted_today")).first()[0] == 2
    assert hiring_stats(first.companies, jobs, NOW, first.companies.first()["company_id"]).count() == 1


def test_top_entries_of_a_large_vocabulary(spark):
    long = spark.range(200_000).selectExpr("1 AS company_id", "DATE '2026-01-01' AS snapshot_date", "'skill' AS dimension", "concat('s', id) AS name", "id % 1000 AS count")
    got = [(r["rank"], r["name"], r["count"]) for r in snap.top_entries(long, 2).orderBy("rank").collect()]
    assert got == [(1, "s100999", 999), (2, "s101999", 999)]


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_thirty_days_rolled_equal_thirty_days_recomputed(spark, one_partition):
    rng = random.Random(3)
    job_schema = "job_id int, company_id int, content_hash string, active boolean, is_us_job boolean"
    record_schema = (
        "job_id int, content_hash string, schema_version string, standardized_title string, required_skills array<string>, preferred_skills array<string>, "
        "seniority string, locations array<struct<city:string,state:string,country:string>>, workplace_type string, domain_tags array<string>"
    )
    companies = spark.createDataFrame([(c,) for c in range(4)], "company_id int")

    def version(ident):
        job = (ident, rng.randrange(5), f"h{rng.randrange(10**6)}", rng.random() < 0.8, rng.choice([True, True, False, None]))
        place = [("Duluth", rng.choice([None, "MN"]), "US")][: rng.randrange(2)]
        record = (ident, job[2] if rng.random() < 0.8 else "older", "v3", rng.choice(["Welder", "Pilot", None, ""]), rng.choices(["sql", "go", " "], k=2), ["go"],
                  rng.choice(["senior", "unknown", None]), place, rng.choice(["remote", None]), rng.choice([[], ["sea", "rail"]]))
        return job, record

    state = {i: version(i) for i in range(40)}
    kinds = ("created", "changed", "removed", "reactivated")

    def frames(versions):
        return (spark.createDataFrame([j for j, _ in versions], job_schema).coalesce(1), spark.createDataFrame([r for _, r in versions], record_schema).coalesce(1))

    def whole(events, day):
        jobs, records = frames(state.values())
        found = snap.current_records(jobs, records)
        return snap.daily_activity(companies, jobs, events, found, day), snap.category_histograms(found, day)

    def rows(df):
        return sorted((sorted((k, str(v)) for k, v in r.asDict().items()) for r in df.collect()), key=str)

    event_schema = "job_id int, event_type string, occurred_at timestamp, metadata string"
    def kept(df):
        return spark.createDataFrame(df.collect(), df.schema).coalesce(1)

    activity, histograms = (kept(d) for d in whole(spark.createDataFrame([], event_schema), "2026-01-01"))
    for number in range(2, 32):
        day = f"2026-01-{number:02}"
        touched = [rng.randrange(60) for _ in range(rng.randrange(8))]
        before = [state[i] for i in set(touched) if i in state]
        for i in touched:
            state[i] = version(i)
        after = [state[i] for i in set(touched)]
        at = datetime(2026, 1, number, rng.randrange(24))
        events = spark.createDataFrame([(i, rng.choice(kinds), at, rng.choice(["{}", '{"baseline": true}'])) for i in touched], event_schema)
        (jobs_before, was), (jobs_after, now) = frames(before), frames(after)
        was, now = snap.current_records(jobs_before, was), snap.current_records(jobs_after, now)
        activity = kept(snap.roll_activity(activity, companies, jobs_before, jobs_after, events, was, now, day))
        histograms = kept(snap.roll_histograms(histograms, was, now, day))
        if number % 10 == 1:
            again = whole(events, day)
            assert rows(activity) == rows(again[0].select(activity.columns)), day
            assert rows(histograms) == rows(again[1].select(histograms.columns)), day


def test_market_snapshot_of_nothing(spark):
    none = trends.market_snapshot(empty(spark, "company_id int, snapshot_date date, total_open_jobs bigint, new_jobs bigint, removed_jobs bigint, changed_jobs bigint, enriched_jobs bigint"))
    row = none.first()
    assert row["snapshot_date"] is None and row["total_open_jobs"] == 0


def test_quality_rules_treat_unknown_as_passing(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "attempts int")
    assert [tuple(r) for r in violations(rows, {"attempts": lambda: F.col("attempts") >= 0}).collect()] == [("attempts", 1)]


# --- streams ----------------------------------------------------------------


def crawl_folders(spark, tmp_path, name, crawls, files):
    """Manifest, postings and sources of crawls (run, source, day, status, titles by job number)."""
    folders = Folders(*(str(tmp_path / name / x) for x in ("manifest", "postings", "sources", "state")))
    spark.createDataFrame([(1, "active"), (2, "active")], "source_id bigint, status string").write.parquet(folders.sources)
    postings, rows = [], []
    for run, source, day, status, found in crawls:
        at = datetime(2026, 10, day, 9)
        rows.append((run, source, status, at, at, len(found), None if status == "success" else "HTTP 500"))
        postings += [(source, run, i, f"j{i}", "lever", "c1", "Acme", title, "Austin, TX", None, None, at, "feed", "text", None, None, None, "{}", f"{title}-{i}") for i, title in found.items()]
    return folders, spark.createDataFrame(rows, MANIFEST_SCHEMA), spark.createDataFrame(postings, POSTING_SCHEMA).repartition(files)


def test_lifecycle_stream_goes_by_crawl(spark, tmp_path):
    day5, day6 = {i: "A" for i in range(30)}, {i: "B" for i in range(1, 31)}
    crawls = [
        (51, 1, 5, "success", day5), (52, 2, 5, "success", {1: "A"}), (61, 1, 6, "success", day6), (62, 2, 6, "failed", {}),
        (72, 2, 7, "success", {}), (82, 2, 8, "success", {1: "A", 2: "A"}),
    ]
    seen = []
    for files in (1, 7):
        folders, manifest, postings = crawl_folders(spark, tmp_path, f"f{files}", crawls, files)
        postings.write.parquet(folders.postings)
        # In three runs, with crawls listed again, and in one.
        parts = (manifest.filter("crawl_run_id < 60"), manifest.filter("crawl_run_id < 70"), manifest) if files > 1 else (manifest,)
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(folders.manifest)
            run_stream(spark, folders)
        events = spark.read.parquet(f"{folders.root}/events")
        jobs = current_state(spark, folders, "jobs", JOB_SCHEMA)
        state = sorted(tuple(r) for r in jobs.select("source_id", "external_job_id", "active", "title", "last_seen_crawl_id").collect())
        counts = sorted((r["crawl_run_id"], r["event_type"], r["count"]) for r in events.groupBy("crawl_run_id", "event_type").count().collect())
        runs = sorted((r["crawl_run_id"], r["status"], r["job_count"], r["deactivation_skipped"]) for r in spark.read.parquet(f"{folders.root}/crawl_runs").collect())
        seen.append((state, counts, runs))
    assert seen[0] == seen[1]
    state, counts, runs = seen[0]
    assert counts == [(51, "created", 30), (52, "created", 1), (61, "changed", 29), (61, "created", 1), (61, "removed", 1), (82, "created", 1)]
    assert sum(active for _, _, active, _, _ in state) == 32 and len(state) == 33
    assert runs == [(51, "success", 30, False), (52, "success", 1, False), (61, "success", 30, False), (62, "failed", None, False), (72, "success", 0, True), (82, "success", 2, False)]
    # Old versions of rewritten parts are gone, others stay readable.
    assert current_state(spark, folders, "sources", "source_id bigint, consecutive_failures int").count() == 2


def run_stream(spark, folders, **options):
    start_lifecycle(spark, folders, cut, parts=2, **options).awaitTermination()


def active_jobs(spark, folders):
    return sorted((r["source_id"], r["external_job_id"]) for r in current_state(spark, folders, "jobs", JOB_SCHEMA).filter("active").collect())


def test_incomplete_crawl_waits_and_holds_back_later_ones(spark, tmp_path):
    crawls = [(51, 1, 5, "success", {i: "A" for i in range(10)}), (61, 1, 6, "success", {0: "A"}), (52, 2, 5, "success", {7: "A"})]
    folders, manifest, postings = crawl_folders(spark, tmp_path, "late", crawls, 2)
    postings.filter("crawl_run_id <> 51 OR pos < 6").write.parquet(folders.postings)
    manifest.coalesce(1).write.parquet(folders.manifest)
    run_stream(spark, folders)
    assert active_jobs(spark, folders) == [(2, "j7")]
    # The manifest is complete; only postings come, some for the second time.
    postings.filter("crawl_run_id = 51 AND pos >= 4").write.mode("append").parquet(folders.postings)
    run_stream(spark, folders, min_previous=1000)
    assert active_jobs(spark, folders) == [(1, "j0"), (2, "j7")]
    runs = spark.read.parquet(f"{folders.root}/crawl_runs/*").collect()
    assert sorted((r["crawl_run_id"], r["job_count"]) for r in runs) == [(51, 10), (52, 1), (61, 1)]
    # Replaced versions and what was carried along are removed, the last two batches stay.
    postings.filter("crawl_run_id = 61").write.mode("append").parquet(folders.postings)
    run_stream(spark, folders)
    assert active_jobs(spark, folders) == [(1, "j0"), (2, "j7")]
    assert not (tmp_path / "late/state/waiting/batch=0").exists() and (tmp_path / "late/state/waiting/batch=1").exists()


def test_postings_that_come_twice_count_once(spark, tmp_path):
    four = {i: "A" for i in range(4)}
    crawls = [(51, 1, 5, "success", four), (61, 1, 6, "success", four), (62, 2, 6, "success", {0: "A"})]
    folders, manifest, postings = crawl_folders(spark, tmp_path, "twice", crawls, 1)
    # Of the second crawl two of four postings have come, each twice; another holds more than it counts.
    postings.filter("crawl_run_id = 51 OR (crawl_run_id = 61 AND pos < 2)").write.parquet(folders.postings)
    postings.filter("crawl_run_id = 61 AND pos < 2").write.mode("append").parquet(folders.postings)
    postings.filter("crawl_run_id = 61").withColumns({"crawl_run_id": F.lit(62).cast("long"), "source_id": F.lit(2).cast("long")}).write.mode("append").parquet(folders.postings)
    manifest.write.parquet(folders.manifest)
    run_stream(spark, folders)
    assert active_jobs(spark, folders) == [(1, f"j{i}") for i in range(4)]
    runs = {r["crawl_run_id"]: r for r in spark.read.parquet(f"{folders.root}/crawl_runs/*").collect()}
    assert sorted(runs) == [51, 62] and (runs[62]["status"], runs[62]["error"]) == ("failed", "4 of 1 postings arrived")


def test_crawl_is_given_up_and_a_late_one_left_out(spark, tmp_path):
    crawls = [(41, 1, 4, "success", {9: "A"}), (51, 1, 5, "success", {i: "A" for i in range(3)}), (61, 1, 6, "success", {5: "A"})]
    folders, manifest, postings = crawl_folders(spark, tmp_path, "given-up", crawls, 1)
    postings.filter("crawl_run_id = 61 OR crawl_run_id = 51 AND pos < 1").write.parquet(folders.postings)
    manifest.filter("crawl_run_id > 50").write.parquet(folders.manifest)
    run_stream(spark, folders, patience=1)
    assert active_jobs(spark, folders) == []
    # The next new rows find crawl 51 out of patience, so 61 is applied; 41 began before that.
    postings.filter("crawl_run_id = 41").write.mode("append").parquet(folders.postings)
    run_stream(spark, folders, patience=1)
    assert active_jobs(spark, folders) == [(1, "j5")]
    manifest.filter("crawl_run_id = 41").write.mode("append").parquet(folders.manifest)
    postings.filter("crawl_run_id = 51").write.mode("append").parquet(folders.postings)
    run_stream(spark, folders, patience=1)
    assert active_jobs(spark, folders) == [(1, "j5")]
    runs = {r["crawl_run_id"]: (r["status"], r["error"]) for r in spark.read.parquet(f"{folders.root}/crawl_runs/*").collect()}
    assert runs == {51: ("failed", "1 of 3 postings arrived"), 61: ("success", None), 41: ("failed", "a later crawl of the source was applied before")}


def test_interrupted_publication_keeps_a_version(spark):
    old, new = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")
    store.replace_table(old, "kept")
    # Stopped between the two renames: only the previous version has a name.
    new.write.mode("overwrite").saveAsTable("kept__next")
    spark.sql("ALTER TABLE kept RENAME TO kept__previous")
    store.recover_table(spark, "kept")
    assert [r["id"] for r in spark.table("kept").collect()] == [1]
    # Stopped before the last drop.
    old.write.saveAsTable("kept__previous")
    store.replace_table(spark.table("kept").union(new), "kept")
    assert sorted(r["id"] for r in spark.table("kept").collect()) == [1, 2]
    assert not spark.catalog.tableExists("kept__previous")
    spark.sql("DROP TABLE kept")


def test_board_files(spark, tmp_path):
    for board, body in (("quarry", {"jobs": [GREENHOUSE]}), ("dune", {"jobs": []}), ("stray", {"jobs": [GREENHOUSE]})):
        (tmp_path / f"{board}.json").write_text(json.dumps(body))
    sources = spark.createDataFrame([(4, "greenhouse", "quarry"), (5, "greenhouse", "dune"), (6, "lever", "stray")], "source_id bigint, provider string, board_id string")
    boards = payloads.of_sources(payloads.read_boards(spark, str(tmp_path), "greenhouse"), sources, 9)
    good, bad = payloads.split_boards(boards)
    postings = payloads.normalize_postings(payloads.raw_postings(good)).collect()
    assert bad.isEmpty() and [(p["source_id"], p["crawl_run_id"], p["external_job_id"]) for p in postings] == [(4, 9, "101")]


def test_building_a_query_starts_no_job(spark):
    # Streams and stored tables are run to be read back.
    stored = {"r1_streamed_lifecycle", "r1_late_crawls", "r2_streamed_daily_counts", "s12_published_days", "s14_appended_rows", "l01_daily_crawl", "l01_second_crawl",
              "s08_upsert_candidates", "j18_lifecycle_diff", "f09_indexed_text_search", "f10_indexed_place_search", "l20_enrich_run", "l20_run_records",
              "p21_stored_view", "a14_report_as_written", "a15_summary_as_written", "a16_summary_as_written"}
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    for name, fn in queries().items():
        if name not in stored:
            before = scheduler.numTotalJobs()
            fn(spark, "/root/testdata/sf0.001")
            assert scheduler.numTotalJobs() == before, name


def test_stored_counts_stand_replays(spark, tmp_path):
    table = counts_table(spark, "stored_counts", f"file://{tmp_path}/counts", buckets=4)
    sink = keyed_sink(table, cut)
    schema = "day date, event_type string, n bigint"
    day = lambda d, kind, n: (datetime(2026, 1, d).date(), kind, n)
    batches = [[day(1, "created", 2)], [day(1, "created", 3), day(2, "removed", 1)], [day(2, "removed", 4)], []]
    for number, replay in [(0, 0), (1, 1), (1, 1), (2, 2), (0, 0), (1, 1), (3, 3)]:
        sink(spark.createDataFrame(batches[number], schema), replay)
    got = sorted((r["day"].day, r["event_type"], r["n"], r["batch"]) for r in table.read().collect())
    assert got == [(1, "created", 3, 1), (2, "removed", 4, 2)]
    # Two versions of at most as many folders as buckets.
    kept = [w for b in (tmp_path / "counts/rows").glob("bucket_no=*") for w in b.glob("write_no=*")]
    assert len(kept) <= 8


def test_facet_counts_of_filtered_jobs_equal_a_scan(spark):
    jobs = client(spark, "/root/testdata/sf0.001").withColumn("number", F.col("id").cast("bigint") * 37)  # several buckets
    stored = cut(facet_bitmaps.merge(*[facet_bitmaps.bitmaps(jobs.where(F.expr(f"number % 3 = {k}")), ORDERS_AS_OF) for k in range(3)]))
    for filters in ({}, {"workplace": ["remote"], "experience": ["years:mid", "seniority:senior"]}, {"location": ["Austin, TX"], "skill": ["sql"], "source": []}, {"company": ["nobody"]}):
        found = search.search(jobs, ORDERS_AS_OF, filters=filters)
        want = {(r["group"], r["value"]): r["count"] for r in search.facets(found, ORDERS_AS_OF).collect() if r["count"]}
        assert {(r["group"], r["value"]): r["count"] for r in facet_bitmaps.counts(stored, filters).collect()} == want
        assert tuple(facet_bitmaps.total(stored, filters).first()) == tuple(search.result_counts(found).first())
    # A text search joins in as one more set.
    found = search.search(jobs, ORDERS_AS_OF, query="urgent", filters={"workplace": ["remote"]})
    hits = facet_bitmaps.numbers(search.search(jobs, ORDERS_AS_OF, query="urgent"))
    assert tuple(facet_bitmaps.total(stored, {"workplace": ["remote"]}, hits).first()) == tuple(search.result_counts(found).first())


def test_a_crawl_sends_no_side_that_grows_to_all_executors(spark):
    out = first_crawl(spark, "/root/testdata/sf0.001")
    for rows in (out.companies, out.result.sources, out.result.queue, out.result.per_source, out.quarantine):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_checking_parses_a_record_once_for_its_shape_and_places(spark):
    plan = enrich.check_records(spark.range(1).selectExpr("id || '' AS data"))._jdf.queryExecution().optimizedPlan().toJSON()
    assert plan.count('"parseJson"') == 1


def test_bitmaps_of_rare_options_take_no_more_than_their_jobs(spark):
    jobs = client(spark, "/root/testdata/sf0.001").limit(200).withColumn("number", F.col("id").cast("bigint") * 40_000)
    stored = facet_bitmaps.bitmaps(jobs, ORDERS_AS_OF)
    rows, size = stored.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("bits").cast("string")))).first()
    assert 0 < size <= 20 * rows  # pages of 32,768 bits took 4 kB each


def test_daily_counts_wait_for_late_events(spark, tmp_path):
    path = str(tmp_path / "events")
    at = [datetime(2026, 1, 1, 3), datetime(2026, 1, 1, 23), datetime(2026, 1, 2, 1), datetime(2026, 1, 4, 1)]
    spark.createDataFrame([(t, "created") for t in at], "occurred_at timestamp, event_type string").write.parquet(path)
    stream = spark.readStream.schema("occurred_at timestamp, event_type string").parquet(path)
    query = daily_event_counts(stream).writeStream.format("memory").queryName("daily_counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(str(r["day"]), r["n"]) for r in spark.table("daily_counts").collect()} == {("2026-01-01", 2), ("2026-01-02", 1)}


def test_long_lists_of_skills_are_spelled_as_one_text(spark):
    entries = "array<struct<name: string, requirement: string>>"

    def plain(given):
        strength = {"mentioned": 1, "preferred": 2, "required": 3}
        best = {}
        for name, requirement in given:
            tidy = None if name is None else enrich.SKILL_ALIASES.get(" ".join(name.split()).lower(), " ".join(name.split()))
            key = None if tidy is None else "".join(c for c in tidy.upper().lower() if c.isalnum())
            if key not in best or strength.get(requirement, 0) > strength.get(best[key][1], 0):
                best[key] = (tidy, requirement)
        return list(best.values())

    rng = random.Random(7)
    names = ["Go", " go ", "GO", "C++", "c", "Data\n Ops", "data ops", "", "  ", "Straße", "STRAßE", "ΟΔΟΣ", "οδος", "İş", "R&D", "\xa0R D　"]
    odd = ["JS", "java script", "node.js", "a\x01b", "A B", "\x01", None]
    levels = ["mentioned", "preferred", "required", "other", None]
    lists = [[(rng.choice(names + odd * (i % 2)), rng.choice(levels)) for _ in range(rng.randrange(40))] for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(lists)), f"id int, given {entries}")
    merged = rows.select("id", enrich.merge_skills(F.col("given")).alias("merged"))
    for row in merged.collect():
        assert [tuple(x) for x in row.merged] == plain(lists[row.id]), lists[row.id]
    # Blanks and signs are searched for in all names of a list at once.
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(array_join(" in plan
