"""Job lifecycle: one crawl batch against the current state.

The whole batch is compared with the state in a single full outer join on
(source_id, external_job_id).  That key is unique on both sides, so a source
holding most of the postings still spreads over all tasks; the join that
attaches per-source facts is split at run time where a source is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import instant
from hirelake.operators.eligibility import eligibility_reason, status_of
from hirelake.operators.joins import many_rows
from hirelake.sources.store import absent, last_per_key

KEY = ["source_id", "external_job_id"]
# Posting columns that replace the stored value whenever a job is seen.
OBSERVED = (
    "provider", "title", "location", "employment_type", "workplace_type", "description_text", "description_html",
    "job_url", "apply_url", "raw_payload", "content_hash",
)
# Classification columns and their value after the content changed.
RESET = {
    "classification_started_at": "timestamp",
    "classification_error": "string",
    "classified_at": "timestamp",
    "classified_content_hash": "string",
}
VERSION_COLUMNS = (
    "content_hash", "title", "location", "employment_type", "workplace_type", "description_text",
    "description_html", "raw_payload",
)
JOB_SCHEMA = (
    "job_id string, source_id bigint, external_job_id string, company_id string, provider string, company string, "
    "title string, location string, employment_type string, workplace_type string, posted_at timestamp, "
    "posted_at_source string, observed_new_after timestamp, observed_new_before timestamp, "
    "description_text string, description_html string, job_url string, apply_url string, raw_payload string, "
    "content_hash string, active boolean, first_seen_at timestamp, last_seen_at timestamp, "
    "last_seen_crawl_id bigint, removed_at timestamp, is_us_job boolean, us_location_reason string, "
    "enrichment_eligibility string, enrichment_eligibility_reason string, classification_status string, "
    "classification_started_at timestamp, classification_attempts int, classification_error string, "
    "classification_version string, classified_at timestamp, classified_content_hash string"
)
QUEUE_SCHEMA = (
    "queue_id string, job_id string, content_hash string, schema_version string, status string, priority int, "
    "reason string, attempts int, created_at timestamp, started_at timestamp, completed_at timestamp, "
    "next_attempt_at timestamp, last_error string, error_class string, retryable boolean"
)
SOURCE_SCHEMA = (
    "source_id bigint, provider string, canonical_url string, source_slug string, board_id string, "
    "company_id string, status string, last_attempt_at timestamp, last_crawled_at timestamp, "
    "last_success_at timestamp, last_failure_at timestamp, last_job_count bigint, consecutive_failures int, "
    "last_error string"
)


def deactivation(previous: Column, current: Column, min_previous: int = 20, min_ratio: float = 0.25) -> Column:
    """STRUCT(allowed, reason): may jobs missing from this crawl be removed?"""
    counts = F.concat(
        F.lit("previous_job_count="), previous.cast("string"), F.lit(", current_job_count="), current.cast("string")
    )
    reason = (
        F.when(previous.isNull() | (previous <= 0), F.lit(None).cast("string"))
        .when(current == 0, F.concat(F.lit("zero-job anomaly: "), counts))
        .when(
            (previous >= min_previous) & (current < previous * min_ratio),
            F.concat(F.lit("mass-drop anomaly: "), counts, F.lit(f", threshold_ratio={min_ratio}")),
        )
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def trusted_count(previous: Column, current: Column, allowed: Column) -> Column:
    """The count later crawls are compared with; an anomalous one is not trusted."""
    return F.when(allowed, current).otherwise(previous)


def crawl_decisions(
    crawls: DataFrame, sources: DataFrame, batch: DataFrame, min_previous: int = 20, min_ratio: float = 0.25
) -> DataFrame:
    """One row per crawled source: counts, baseline flag and the removal decision.

    ``crawls``: source_id, crawl_run_id, started_at, status ('success' or 'failed'), error.
    """
    counts = batch.groupBy("source_id").agg(F.count(F.lit(1)).alias("job_count"))
    known = many_rows(sources.select("source_id", "last_success_at", "last_job_count"))
    decided = crawls.join(known, "source_id", "left").join(many_rows(counts), "source_id", "left").fillna(0, ["job_count"])
    decision = deactivation(F.col("last_job_count"), F.col("job_count"), min_previous, min_ratio)
    return decided.withColumn("succeeded", F.col("status") == "success").withColumn("decision", decision).select(
        "source_id", "crawl_run_id", "started_at", "succeeded", "error", "job_count", "last_job_count",
        "last_success_at", F.col("last_success_at").isNull().alias("baseline"),
        (F.col("succeeded") & F.col("decision.allowed")).alias("may_remove"), F.col("decision.reason").alias("anomaly"),
    )


def diff(state: DataFrame, batch: DataFrame, decisions: DataFrame) -> DataFrame:
    """State and batch side by side (``old_*`` / ``new_*``) with one flag per outcome."""
    latest = last_per_key(batch, KEY, [F.col("pos")])
    old = state.selectExpr(*KEY, *[f"`{c}` AS `old_{c}`" for c in state.columns if c not in KEY], "true AS in_state")
    new = latest.selectExpr(*KEY, *[f"`{c}` AS `new_{c}`" for c in latest.columns if c not in KEY], "true AS in_batch")
    joined = old.join(new, KEY, "full_outer")
    crawled = decisions.select(
        "source_id", "crawl_run_id", "started_at", "succeeded", "may_remove", "baseline", "last_success_at"
    )
    rows = joined.join(many_rows(crawled), "source_id", "left")
    seen = "coalesce(in_batch AND succeeded, false)"
    return rows.selectExpr(
        "*",
        f"{seen} AS is_seen",
        f"{seen} AND in_state IS NULL AS is_created",
        f"{seen} AND in_state IS NOT NULL AND NOT (old_content_hash <=> new_content_hash) AS is_changed",
        f"{seen} AND in_state IS NOT NULL AND NOT old_active AS is_reactivated",
        f"NOT {seen} AND coalesce(old_active AND may_remove, false) AS is_removed",
        # Postings of a failed crawl are not applied.
    ).where("in_state IS NOT NULL OR is_seen")


def new_job_id(source_id: Column, external_job_id: Column) -> Column:
    """Stable 128-bit id of a job's natural key."""
    return F.left(F.sha2(F.concat_ws("\x1f", source_id.cast("string"), external_job_id), 256), F.lit(32))


def with_outcome(rows: DataFrame, as_of, window_days: int = 1) -> DataFrame:
    """Add job id, eligibility and queue entry of every diff row."""
    posted = F.coalesce("new_posted_at", "old_posted_at")
    # Scope is still unknown when a job is created.
    reason = eligibility_reason(posted, F.col("old_is_us_job"), as_of, window_days)
    job_id = F.coalesce("old_job_id", new_job_id(F.col("source_id"), F.col("external_job_id")))
    queued = F.col("eligibility") == "eligible"
    return (
        rows.withColumn("job_id", job_id)
        .withColumn("eligibility_reason", reason)
        .withColumn("eligibility", status_of(F.col("eligibility_reason")))
        .withColumn(
            "queue_reason",
            F.when(queued & F.col("is_created") & F.col("baseline"), "bootstrap")
            .when(queued & F.col("is_created"), "new_job")
            .when(queued & F.col("is_changed"), "changed_job"),
        )
        .withColumn(
            "queue_priority",
            F.when(F.col("queue_reason") == "bootstrap", 3)
            .when(F.col("queue_reason") == "new_job", 1)
            .when(F.col("queue_reason") == "changed_job", 2),
        )
    )


def next_state(rows: DataFrame, as_of) -> DataFrame:
    """The jobs table after the crawl."""
    now = instant(as_of)
    seen, created, changed = F.col("is_seen"), F.col("is_created"), F.col("is_changed")
    undated = F.col("new_posted_at").isNull() & F.col("last_success_at").isNotNull()
    values = {c: F.expr(f"if(is_seen, new_{c}, old_{c}) AS {c}") for c in OBSERVED}
    values |= {
        c: F.expr(f"if(is_seen, coalesce(new_{c}, old_{c}), old_{c}) AS {c}")
        for c in ("company_id", "company", "posted_at", "posted_at_source")
    }
    values["observed_new_after"] = F.coalesce("old_observed_new_after", F.when(seen & undated, F.col("last_success_at")))
    values["observed_new_before"] = F.coalesce("old_observed_new_before", F.when(seen & undated, F.col("started_at")))
    values["active"] = F.when(seen, True).when(F.col("is_removed"), False).otherwise(F.col("old_active"))
    values["first_seen_at"] = F.when(created, now).otherwise(F.col("old_first_seen_at"))
    values["last_seen_at"] = F.when(seen, now).otherwise(F.col("old_last_seen_at"))
    values["last_seen_crawl_id"] = F.when(seen, F.col("crawl_run_id")).otherwise(F.col("old_last_seen_crawl_id"))
    values["removed_at"] = F.when(F.col("is_removed"), now).when(~seen, F.col("old_removed_at"))
    values["enrichment_eligibility"] = F.when(seen, F.col("eligibility")).otherwise(F.col("old_enrichment_eligibility"))
    values["enrichment_eligibility_reason"] = F.when(seen, F.col("eligibility_reason")).otherwise(
        F.col("old_enrichment_eligibility_reason")
    )
    values["classification_status"] = (
        F.when(seen & (F.col("eligibility") == "not_eligible"), "not_eligible")
        .when(created | changed, "pending")
        .otherwise(F.col("old_classification_status"))
    )
    values["classification_attempts"] = F.when(created | changed, 0).otherwise(F.col("old_classification_attempts"))
    values |= {c: F.when(~changed, F.col(f"old_{c}")).cast(kind) for c, kind in RESET.items()}
    carried = [c[4:] for c in rows.columns if c.startswith("old_") and c != "old_job_id"]
    return rows.select("job_id", *KEY, *[values.get(c, F.col(f"old_{c}")).alias(c) for c in carried])


def lifecycle_events(rows: DataFrame, as_of, pipeline_run_id=None) -> DataFrame:
    """created / changed / reactivated / removed rows; one posting may give two."""
    created = F.when(F.col("baseline"), '{"baseline": true}').otherwise('{"baseline": false}')

    def event(flag: str, name: str, metadata: Column) -> Column:
        return F.when(F.col(flag), F.struct(F.lit(name).alias("event_type"), metadata.alias("metadata")))

    plain = F.lit("{}")
    kinds = F.array(
        event("is_created", "created", created),
        event("is_changed", "changed", plain),
        event("is_reactivated", "reactivated", plain),
        event("is_removed", "removed", plain),
    )
    return rows.select(
        "job_id",
        F.inline(F.filter(kinds, lambda e: e.isNotNull())),
        F.col("crawl_run_id"),
        F.lit(pipeline_run_id).cast("bigint").alias("pipeline_run_id"),
        instant(as_of).alias("occurred_at"),
    ).withColumn("occurred_on", F.to_date("occurred_at"))


def superseded_versions(rows: DataFrame, as_of) -> DataFrame:
    """Old content of changed jobs that had a content hash."""
    kept = rows.filter(F.col("is_changed") & (F.col("old_content_hash") != ""))
    return kept.select(
        "job_id", *[F.col(f"old_{c}").alias(c) for c in VERSION_COLUMNS], instant(as_of).alias("captured_at")
    )


def queue_id(job_id: Column, content_hash: Column, schema_version: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", job_id.cast("string"), content_hash, schema_version), 256), F.lit(32))


def queue_entries(rows: DataFrame, queue: DataFrame, as_of, schema_version: str = "v3") -> DataFrame:
    """Queue rows to add; a (job, content, schema) already queued is left alone."""
    version = F.lit(schema_version)
    fresh = rows.filter(F.col("queue_reason").isNotNull()).select(
        queue_id(F.col("job_id"), F.col("new_content_hash"), version).alias("queue_id"),
        "job_id",
        F.col("new_content_hash").alias("content_hash"),
        version.alias("schema_version"),
        F.lit("pending").alias("status"),
        F.col("queue_priority").alias("priority"),
        F.col("queue_reason").alias("reason"),
        F.lit(0).alias("attempts"),
        instant(as_of).alias("created_at"),
    )
    return absent(fresh, queue, ["job_id", "content_hash", "schema_version"])


def source_summary(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per crawled source: outcome and numbers of new, changed and removed jobs."""
    def count(flag: Column, name: str) -> Column:
        return F.count(F.when(flag, 1)).alias(name)

    counted = rows.groupBy("source_id").agg(
        count(F.col("is_created") & ~F.col("baseline"), "jobs_new"),
        count(F.col("is_changed"), "jobs_changed"),
        count(F.col("is_removed"), "jobs_removed"),
    )
    return decisions.join(many_rows(counted), "source_id", "left").fillna(0, ["jobs_new", "jobs_changed", "jobs_removed"])


def crawl_run_rows(decisions: DataFrame, as_of) -> DataFrame:
    """The crawl runs as they ended: status, times, count, warning, and whether removal was skipped."""
    ok, anomaly = F.col("succeeded"), F.col("anomaly").isNotNull()
    return decisions.select(
        "crawl_run_id",
        "source_id",
        F.when(ok, "success").otherwise("failed").alias("status"),
        "started_at",
        instant(as_of).alias("finished_at"),
        F.when(ok, F.col("job_count")).alias("job_count"),
        F.when(ok, F.col("anomaly")).alias("warning"),
        (ok & anomaly).alias("deactivation_skipped"),
        F.when(~ok, F.col("error")).alias("error"),
    )


def crawl_summary(per_source: DataFrame) -> DataFrame:
    return per_source.agg(*crawl_figures())


def crawl_figures() -> list[Column]:
    """The totals of a crawl over its sources, for an aggregate or for ``store.append_counted``."""
    ok = F.col("succeeded")

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(column))), F.lit(0)).alias(name)

    return [
        F.count(F.lit(1)).alias("source_count"),
        F.count(F.when(ok, 1)).alias("successful_sources"),
        F.count(F.when(~ok, 1)).alias("failed_sources"),
        F.count(F.when(ok & F.col("anomaly").isNotNull(), 1)).alias("anomaly_sources"),
        total("job_count", "job_count"),
        total("jobs_new", "jobs_new"),
        total("jobs_changed", "jobs_changed"),
        total("jobs_removed", "jobs_removed"),
    ]


def next_sources(sources: DataFrame, decisions: DataFrame, as_of, max_failures: int = 3) -> DataFrame:
    """Source bookkeeping after the crawl; repeated failure deactivates a source."""
    now = instant(as_of)
    outcome = decisions.select(
        "source_id", "started_at", "succeeded", "job_count", F.col("anomaly").isNull().alias("_trusted"), F.col("error").alias("_error")
    )
    joined = sources.join(many_rows(outcome), "source_id", "left")
    values = source_after(F.col, F.col("succeeded"), now, F.col("job_count"), F.col("_trusted"), F.col("_error"), max_failures)
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in sources.columns])


def source_after(
    old: Callable[[str], Column], succeeded: Column, now: Column, count: Column, trusted: Column, error: Column, max_failures: int = 3
) -> dict[str, Column]:
    """What a crawl leaves in its source's row; ``succeeded`` is null where there was none."""
    ok, failed = F.coalesce(succeeded, F.lit(False)), F.coalesce(~succeeded, F.lit(False))
    failures = F.coalesce(old("consecutive_failures"), F.lit(0))
    return {
        "status": F.when(failed & (failures + 1 >= max_failures), "inactive").otherwise(old("status")),
        "last_attempt_at": F.when(ok | failed, now).otherwise(old("last_attempt_at")),
        "last_crawled_at": F.when(ok, now).otherwise(old("last_crawled_at")),
        "last_success_at": F.when(ok, now).otherwise(old("last_success_at")),
        "last_failure_at": F.when(failed, now).otherwise(old("last_failure_at")),
        "last_job_count": F.when(ok, trusted_count(old("last_job_count"), count, trusted)).otherwise(old("last_job_count")),
        "consecutive_failures": F.when(ok, 0).when(failed, failures + 1).otherwise(old("consecutive_failures")),
        "last_error": F.when(failed, error).when(~ok, old("last_error")),
    }


def fold_crawls(
    crawls: DataFrame, counts: DataFrame, sources: DataFrame, min_previous: int = 20, min_ratio: float = 0.25, max_failures: int = 3
) -> DataFrame:
    """Several crawls of each source, one after the other: the source's columns as
    the last one leaves them, and ``decisions``, an array with the row of
    ``crawl_decisions`` of every crawl in order.

    ``crawls``: source_id, crawl_run_id, started_at, status, error; ``counts``:
    crawl_run_id, job_count.  A source's crawls are narrow rows of one group.
    """
    steps = crawls.join(counts, "crawl_run_id", "left").groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("started_at", "crawl_run_id", "status", "error", F.coalesce("job_count", F.lit(0)).alias("job_count")))).alias("steps")
    )
    kept = ("status", "last_attempt_at", "last_crawled_at", "last_success_at", "last_failure_at", "last_job_count", "consecutive_failures", "last_error")
    kinds = {c: sources.schema[c].dataType for c in kept}
    decision = (
        "array<struct<source_id bigint, crawl_run_id bigint, started_at timestamp, succeeded boolean, error string, job_count bigint, "
        "last_job_count bigint, last_success_at timestamp, baseline boolean, may_remove boolean, anomaly string>>"
    ).replace(" bigint", ":bigint").replace(" timestamp", ":timestamp").replace(" boolean", ":boolean").replace(" string", ":string")

    def step(state: Column, crawl: Column) -> Column:
        ok, count = crawl["status"] == "success", crawl["job_count"]
        outcome = deactivation(state["last_job_count"], count, min_previous, min_ratio)
        anomaly = outcome["reason"]
        after = source_after(lambda c: state[c], ok, crawl["started_at"], count, anomaly.isNull(), crawl["error"], max_failures)
        taken = F.struct(
            state["source_id"].alias("source_id"), crawl["crawl_run_id"].alias("crawl_run_id"), crawl["started_at"].alias("started_at"),
            ok.alias("succeeded"), crawl["error"].alias("error"), count.alias("job_count"), state["last_job_count"].alias("last_job_count"),
            state["last_success_at"].alias("last_success_at"), state["last_success_at"].isNull().alias("baseline"),
            (ok & outcome["allowed"]).alias("may_remove"), anomaly.alias("anomaly"),
        )
        return F.struct(
            state["source_id"].alias("source_id"),
            *[after[c].cast(kinds[c]).alias(c) for c in kept],
            F.concat(state["decisions"], F.array(taken).cast(decision)).alias("decisions"),
        )

    first = F.struct("source_id", *kept, F.array().cast(decision).alias("decisions"))
    folded = sources.join(steps, "source_id", "left").withColumn(
        "_after", F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), first, step)
    )
    columns = [F.col(f"_after.{c}").alias(c) if c in kept else F.col(c) for c in sources.columns]
    return folded.select(*columns, F.col("_after.decisions").alias("decisions"))


@dataclass(frozen=True)
class CrawlResult:
    """All outputs of one crawl; each is derived from the same diff."""

    jobs: DataFrame
    events: DataFrame
    versions: DataFrame
    queue: DataFrame
    sources: DataFrame
    per_source: DataFrame
    crawl_runs: DataFrame


def apply_crawl(
    state: DataFrame,
    batch: DataFrame,
    crawls: DataFrame,
    sources: DataFrame,
    queue: DataFrame,
    as_of,
    *,
    schema_version: str = "v3",
    window_days: int = 1,
    min_previous: int = 20,
    min_ratio: float = 0.25,
    pipeline_run_id=None,
    cut=None,
) -> CrawlResult:
    """Apply one crawl batch.

    ``cut`` (for example ``session.cut_lineage``) materialises the diff so that
    writing the outputs reads it instead of joining once per output.
    """
    decisions = crawl_decisions(crawls, sources, batch, min_previous, min_ratio)
    rows = with_outcome(diff(state, batch, decisions), as_of, window_days)
    if cut is not None:
        rows = cut(rows)
    return CrawlResult(
        jobs=next_state(rows, as_of),
        events=lifecycle_events(rows, as_of, pipeline_run_id),
        versions=superseded_versions(rows, as_of),
        queue=queue_entries(rows, queue, as_of, schema_version),
        sources=next_sources(sources, decisions, as_of),
        per_source=source_summary(rows, decisions),
        crawl_runs=crawl_run_rows(decisions, as_of),
    )
