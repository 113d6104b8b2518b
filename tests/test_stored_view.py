"""The canonical view kept from day to day equals the view made from everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelake.operators import canonical as canon
from hirelake.operators.stored_view import StoredView, Touched
from hirelake.plans.standins import ORDERS_AS_OF, standin
from hirelake.sources.buckets import BUCKET_ROWS, buckets_for

SF = "/root/testdata/sf0.001"
VERSION = "job_id bigint, title string, location string"
EVENT = "job_id bigint, event_type string, occurred_at timestamp"
JOB = "job_id bigint, content_hash string, title string, location string, last_seen_at timestamp"
RECORD = "job_id bigint, enrichment_id bigint, content_hash string, schema_version string, created_at timestamp, salary_min double, salary_max double"
SHOWN = ["job_id", "original_title", "salary_min", "salary_changed", "version_count", "title_changed", "location_changed", "last_changed_at"]
START = datetime(2026, 1, 1)


def widen(spark, rows, schema, like):
    """Rows with all columns of a stand-in, the others NULL."""
    df = spark.createDataFrame(rows, schema)
    full = standin(spark, SF, like).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in full])


def day_of(spark, jobs=(), records=(), versions=(), events=()):
    return (
        widen(spark, list(jobs), JOB, "order_jobs"),
        widen(spark, list(records), RECORD, "enrichments"),
        spark.createDataFrame(list(versions), VERSION),
        spark.createDataFrame(list(events), EVENT),
    )


def make(spark, tmp_path, name, buckets=8):
    schemas = standin(spark, SF, "order_jobs").schema, standin(spark, SF, "enrichments").schema
    return StoredView.create(spark, name, f"file://{tmp_path}/{name}", *schemas, buckets=buckets)


def shown(view):
    return sorted((tuple(map(str, r)) for r in view.select(*SHOWN).collect()))


def test_random_days_equal_the_full_build(spark, tmp_path):
    rng, kept = random.Random(4), make(spark, tmp_path, "sv_random")
    jobs, records, versions, events, days = {}, {}, [], [], []
    for number in range(4):
        at = START + timedelta(days=number)
        named = rng.sample(range(1, 25), [20, 6, 6, 0][number])
        new_jobs = [(j, rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice(["p", None]), at) for j in named]
        # Records, versions and events also of jobs that the day does not name, or that come later.
        new_records = {
            (j, rng.randrange(4)): (rng.choice("abc"), rng.choice(["v3", "v3", "v2"]), at + timedelta(minutes=i), rng.choice([1.0, 2.0, None]), None)
            for i, j in enumerate(rng.choices(range(1, 28), k=15))
        }
        new_versions = [(rng.randrange(1, 28), rng.choice(["x", "y", None]), rng.choice(["p", None])) for _ in range(5)]
        new_events = [(rng.randrange(1, 28), rng.choice(["changed", "created"]), at + timedelta(hours=i)) for i in range(5)]
        day = day_of(spark, new_jobs, [(*k, *v) for k, v in new_records.items()], new_versions, new_events)
        days.append(day)
        touched = kept.apply(number, *day)
        ids = {*named, *(j for j, _ in new_records), *(v[0] for v in new_versions), *(e[0] for e in new_events)}
        assert touched.rebuilt == len(ids)
        jobs |= {j[0]: j for j in new_jobs}
        records |= new_records
        versions += new_versions
        events += new_events
        full = canon.canonical_jobs(*day_of(spark, jobs.values(), [(*k, *v) for k, v in records.items()], versions, events), "2026-02-01")
        assert shown(kept.read("2026-02-01")) == shown(full)
    before = shown(kept.read("2026-02-01"))
    # Days given again, also an older one, change nothing.
    assert kept.apply(3, *days[3]).rebuilt >= 0 and kept.apply(1, *days[1])
    assert shown(kept.read("2026-02-01")) == before
    kept.compact()
    assert kept.records.read().count() == len(records)
    assert shown(kept.read("2026-02-01")) == before


def test_an_interrupted_day_is_given_again(spark, tmp_path, monkeypatch):
    kept = make(spark, tmp_path, "sv_broken")
    kept.apply(0, *day_of(spark, [(1, "a", "x", None, START)], [(1, 1, "a", "v3", START, 5.0, None)]))
    day = day_of(spark, [(1, "b", "y", None, START)], [(1, 2, "b", "v3", START, 6.0, None)], [(1, "x", None)], [(1, "changed", START)])

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(StoredView, "_rebuild", stop)
        with pytest.raises(RuntimeError, match="lost"):
            kept.apply(1, *day)
    # The records have been appended, the view is that of the day before.
    assert shown(kept.read("2026-02-01"))[0][1:4] == ("x", "5.0", "False")
    for _ in range(2):
        kept.apply(1, *day)
        assert shown(kept.read("2026-02-01")) == [("1", "y", "6.0", "True", "2", "True", "False", str(START))]


def test_content_that_returns_finds_its_record(spark, tmp_path):
    kept = make(spark, tmp_path, "sv_return")
    kept.apply(0, *day_of(spark, [(1, "a", "x", None, START)], [(1, 1, "a", "v3", START, 5.0, None)]))
    kept.apply(1, *day_of(spark, [(1, "b", "x", None, START)]))
    assert shown(kept.read("2026-02-01"))[0][2] == "None"
    kept.apply(2, *day_of(spark, [(1, "a", "x", None, START)]))
    assert shown(kept.read("2026-02-01"))[0][2] == "5.0"


def test_null_ids_repeated_jobs_and_empty_days(spark, tmp_path):
    kept = make(spark, tmp_path, "sv_cases")
    assert kept.apply(0, *day_of(spark)) == Touched(0, 0) and kept.read("2026-02-01").isEmpty()
    later = START + timedelta(hours=1)
    rows = [(None, "a", "x", None, START), (1, "a", "old", None, START), (1, "a", "new", None, later), (1, "a", "new", None, later)]
    kept.apply(1, *day_of(spark, rows, [(None, 1, "a", "v3", START, 1.0, None)], [(None, "x", None)], [(9, "changed", START)]))
    # Job 9 has history and is not there yet.
    assert [r[:2] for r in shown(kept.read("2026-02-01"))] == [("1", "new")]
    assert kept.apply(2, *day_of(spark)) == Touched(0, 0)
    kept.apply(3, *day_of(spark, [(9, "a", "x", None, START)]))
    assert [r[-1] for r in shown(kept.read("2026-02-01"))] == ["None", str(START)]
    with pytest.raises(ValueError, match="columns"):
        kept.apply(4, spark.createDataFrame([(1,)], "job_id bigint"), *day_of(spark)[1:])


def test_a_small_day_reads_and_rewrites_few_buckets(spark, tmp_path):
    kept = make(spark, tmp_path, "sv_small", buckets=32)
    tables = [standin(spark, SF, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events")]
    kept.apply(0, *tables)
    assert sorted(map(str, kept.read(ORDERS_AS_OF).collect())) == sorted(map(str, canon.canonical_jobs(*tables, ORDERS_AS_OF).collect()))
    plans, rebuild = [], StoredView._rebuild

    def seen(self, rows, updates, batch_no):
        plans.append((rows, rebuild(self, rows, updates, batch_no)))
        return plans[-1][1]

    day = day_of(spark, [(7, "a", "x", None, START)])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(StoredView, "_rebuild", seen)
        touched = kept.apply(1, *day)
    assert touched.rebuilt == 1 and touched.copied < 1500 / 32 * 3
    # One bucket of either table is read; what it holds is not shuffled on its way to the kept rows.
    rows, built = plans[0]
    assert rows.select(F.input_file_name()).distinct().count() <= 2
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan.split("Exchange hashpartitioning")[0]


def test_stored_records_are_not_shuffled_to_find_a_winner(spark, tmp_path):
    kept = make(spark, tmp_path, "sv_dealt", buckets=16)
    tables = [standin(spark, SF, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events")]
    kept.apply(0, *tables)
    jobs = tables[0].select("job_id", "content_hash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not tiny
    try:
        plan = canon.enrichment_facts(jobs, kept.records.read().drop("batch_no"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Only the jobs are dealt, to lie like the buckets.
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_records_of_a_day_are_dealt_once(spark, tmp_path, monkeypatch):
    kept, plans = make(spark, tmp_path, "sv_once", buckets=16), []
    write = type(kept.records)._write

    def seen(self, rows, *rest, **named):
        if self.name == kept.records.name:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, *rest, **named)

    monkeypatch.setattr(type(kept.records), "_write", seen)
    kept.apply(0, *[standin(spark, SF, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events")])
    assert len(plans) == 1 and plans[0].count("Exchange") == 1


def test_buckets_grow_with_the_rows(spark):
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert buckets_for(spark, 0) == max(16, shuffled)
    assert buckets_for(spark, 216_000_000) * BUCKET_ROWS >= 216_000_000


def test_a_day_is_shuffled_packed_and_its_rebuild_not_at_all(spark, tmp_path, monkeypatch):
    kept, plans, rebuild = make(spark, tmp_path, "sv_packed", buckets=16), [], StoredView._rebuild
    write = type(kept.records)._write

    def seen(self, rows, updates, batch_no):
        built = rebuild(self, rows, updates, batch_no)
        plans.append(built._jdf.queryExecution().executedPlan().toString())
        return built

    def written(self, rows, *rest, **named):
        if self.name in (kept.records.name, kept.day.name):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, *rest, **named)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not tiny
    monkeypatch.setattr(StoredView, "_rebuild", seen)
    monkeypatch.setattr(type(kept.records), "_write", written)
    tables = [standin(spark, SF, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events")]
    try:
        for number in range(2):
            kept.apply(number, *tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 6
    for records, day, built in (plans[:3], plans[3:]):
        # Rows leave their task as packs only: records, jobs and history, each once.
        for plan, times in ((records, 1), (day, 2)):
            shuffled = plan.split("Exchange")[1:]
            assert len(shuffled) == times and all("MapInArrow" in below for below in shuffled)
        assert "Exchange" not in built
    # Nothing of a day is left but the tables.
    assert kept.day.versions() == [] and kept.day.read().isEmpty()


def test_of_rows_of_a_day_with_one_key_the_last_counts(spark, tmp_path):
    kept = make(spark, tmp_path, "sv_last")
    later = START + timedelta(hours=1)
    records = [(1, 1, "a", "v3", later, 2.0, None), (1, 1, "a", "v3", START, 1.0, None), (1, 1, "a", "v3", None, 3.0, None)]
    records += [(1, None, "a", "v3", START, 4.0, None), (1, None, "a", "v3", later + timedelta(hours=1), 5.0, None), (2, 1, "a", "v3", None, 6.0, None)]
    # Of jobs seen at one time the one with the greater content, also of one that is NULL.
    jobs = [(1, "a", "x", None, START), (1, None, "y", None, START), (2, "b", "x", None, START), (2, "a", "z", None, later)]
    kept.apply(0, *day_of(spark, jobs, records))
    held = sorted(map(str, kept.records.read().select("job_id", "enrichment_id", "salary_min").collect()))
    assert held == sorted(f"Row(job_id={j}, enrichment_id={e}, salary_min={s})" for j, e, s in [(1, 1, 2.0), (1, None, 5.0), (2, 1, 6.0)])
    # A record without a number cannot be the current one.
    assert [r[:3] for r in shown(kept.read("2026-02-01"))] == [("1", "x", "None"), ("2", "z", "6.0")]
