"""Enrichment queue: what is due, what a run takes, and what each outcome changes.

Each step maps whole tables to their next version.  A job matches at most one
queue row per schema by (job_id, content_hash), so those joins cannot be
skewed; joins on the job alone aggregate or filter the queue side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import instant, retry_delay_seconds
from hirelake.functions.scope import classify_scope
from hirelake.operators.canonical import jobs_without_enrichment
from hirelake.operators.eligibility import eligibility_reason, status_of, window_reason, window_start
from hirelake.operators.lifecycle import queue_id
from hirelake.sources.store import upsert, without

MAX_ATTEMPTS = 5
DEFER_MINUTES = 15
OPEN = ("pending", "processing")


def _update(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where ``condition`` is true, like an UPDATE."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(
        *[
            (F.when(hit, values[c].cast(df.schema[c].dataType)).otherwise(F.col(c)) if c in values else F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def _null() -> Column:
    return F.lit(None)


# --- due work ---------------------------------------------------------------


def due(
    queue: DataFrame, jobs: DataFrame, as_of, schema_version: str = "v3", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Pending queue rows whose job is current, active, eligible and recent."""
    waiting = queue.filter(
        (F.col("status") == "pending")
        & (F.col("attempts") < max_attempts)
        & (F.col("schema_version") == schema_version)
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= instant(as_of)))
    )
    workable = jobs.filter(
        F.col("active") & (F.col("enrichment_eligibility") == "eligible") & (F.col("posted_at") >= window_start(as_of))
    ).select("job_id", "content_hash")
    return waiting.join(workable, ["job_id", "content_hash"], "left_semi")


def backlog(queue: DataFrame, jobs: DataFrame, as_of, **options) -> DataFrame:
    return due(queue, jobs, as_of, **options).agg(F.count(F.lit(1)).alias("backlog"))


def claim(
    queue: DataFrame, jobs: DataFrame, as_of, budget: int, attempted: DataFrame | None = None, **options
) -> DataFrame:
    """The run's batch: the first ``budget`` due rows by priority, age and id."""
    ready = due(queue, jobs, as_of, **options)
    if attempted is not None:
        ready = without(ready, attempted, "queue_id")
    return ready.orderBy("priority", "created_at", "queue_id").limit(budget)


def mark_claimed(queue: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """Queue with the batch in processing and one more attempt counted."""
    updates = batch.select(
        "queue_id", F.lit("processing").alias("status"), instant(as_of).alias("started_at"),
        (F.col("attempts") + 1).alias("attempts"), _null().cast("string").alias("last_error"),
        _null().cast("string").alias("error_class"), _null().cast("timestamp").alias("next_attempt_at"),
    )
    return upsert(queue, updates, ["queue_id"])


# --- keeping the queue in step with the jobs --------------------------------


def out_of_window(posted_at: Column, as_of, days: int = 1) -> Column:
    return posted_at.isNull() | (posted_at < window_start(as_of, days))


def expiry_reason(posted_at: Column, days: int = 1) -> Column:
    return F.when(posted_at.isNull(), "missing_posted_at").otherwise(window_reason(days))


def expire_jobs(jobs: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Jobs outside the window stop being eligible."""
    status = F.col("classification_status")
    hit = out_of_window(F.col("posted_at"), as_of, days) & (
        F.coalesce(F.col("enrichment_eligibility") == "eligible", F.lit(False))
        | F.coalesce(status.isin(*OPEN), F.lit(False))
    )
    return _update(
        jobs,
        hit,
        {
            "enrichment_eligibility": F.lit("not_eligible"),
            "enrichment_eligibility_reason": expiry_reason(F.col("posted_at"), days),
            "classification_status": F.when(status.isin(*OPEN), "not_eligible").otherwise(status),
            "classification_started_at": _null(),
        },
    )


def expire_queue(queue: DataFrame, jobs: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Open queue rows of out-of-window jobs are closed, whatever their content."""
    dates = jobs.select("job_id", F.col("posted_at").alias("_posted"), F.lit(True).alias("_job"))
    hit = F.col("_job") & F.col("status").isin(*OPEN) & out_of_window(F.col("_posted"), as_of, days)
    closed = _update(
        queue.join(dates, "job_id", "left"),
        hit,
        {
            "status": F.lit("not_eligible"),
            "started_at": _null(),
            "completed_at": instant(as_of),
            "next_attempt_at": _null(),
            "last_error": expiry_reason(F.col("_posted"), days),
        },
    )
    return closed.select(*queue.columns)


def set_eligibility(jobs: DataFrame, as_of, window_days: int = 1, undated_eligible: bool = False) -> DataFrame:
    """Recompute eligibility of every job under a window of any length."""
    reason = eligibility_reason(
        F.col("posted_at"), F.col("is_us_job"), as_of, window_days=window_days, undated_eligible=undated_eligible
    )
    return jobs.withColumn("enrichment_eligibility_reason", reason).withColumn(
        "enrichment_eligibility", status_of(F.col("enrichment_eligibility_reason"))
    )


def resync_jobs(jobs: DataFrame) -> DataFrame:
    """Show 'not_eligible' as the status of every job that is not eligible."""
    return _update(
        jobs,
        F.col("enrichment_eligibility") == "not_eligible",
        {
            "classification_status": F.lit("not_eligible"),
            "classification_started_at": _null(),
            "classification_error": _null(),
        },
    )


def resync_queue(queue: DataFrame, jobs: DataFrame, as_of) -> DataFrame:
    """Close queue rows of current content whose job is not eligible."""
    blocked = jobs.filter(F.col("enrichment_eligibility") == "not_eligible").select(
        "job_id", "content_hash", F.lit(True).alias("_blocked")
    )
    closed = _update(
        queue.join(blocked, ["job_id", "content_hash"], "left"),
        F.col("_blocked") & (F.col("status") != "not_eligible"),
        {
            "status": F.lit("not_eligible"),
            "started_at": _null(),
            "completed_at": instant(as_of),
            "last_error": _null(),
        },
    )
    return closed.select(*queue.columns)


# --- filling ----------------------------------------------------------------


def bootstrap_rows(jobs: DataFrame, enrichments: DataFrame, as_of, schema_version: str = "v3") -> DataFrame:
    """Queue rows for eligible jobs that lack an enrichment of their content."""
    wanted = jobs.filter(
        F.col("active")
        & F.col("content_hash").isNotNull()
        & (F.col("enrichment_eligibility") == "eligible")
        & (F.col("posted_at") >= window_start(as_of))
        & F.coalesce("is_us_job", F.lit(True))
    )
    version = F.lit(schema_version)
    return jobs_without_enrichment(wanted, enrichments, schema_version).select(
        queue_id(F.col("job_id"), F.col("content_hash"), version).alias("queue_id"),
        "job_id",
        "content_hash",
        version.alias("schema_version"),
        F.lit("pending").alias("status"),
        F.lit(3).alias("priority"),
        F.lit("bootstrap").alias("reason"),
        F.lit(0).alias("attempts"),
        instant(as_of).alias("created_at"),
        *[_null().cast("timestamp").alias(c) for c in ("started_at", "completed_at", "next_attempt_at")],
        *[_null().cast("string").alias(c) for c in ("last_error", "error_class")],
        _null().cast("boolean").alias("retryable"),
    )


def bootstrap(queue: DataFrame, jobs: DataFrame, enrichments: DataFrame, as_of, schema_version: str = "v3") -> DataFrame:
    """Queue after the fill: finished rows are reopened, open ones left alone."""
    keep = {"queue_id": lambda old, new: old, "created_at": lambda old, new: old}
    return upsert(
        queue,
        bootstrap_rows(jobs, enrichments, as_of, schema_version),
        ["job_id", "content_hash", "schema_version"],
        keep,
        when=lambda old, new: old("status").isin("completed", "failed"),
    )


def requeue_failed(queue: DataFrame, jobs: DataFrame, as_of, include_permanent: bool = False) -> DataFrame:
    """Failed rows that are retryable (or all) and still current become pending."""
    workable = jobs.filter(
        F.col("active") & (F.col("enrichment_eligibility") == "eligible") & (F.col("posted_at") >= window_start(as_of))
    ).select("job_id", "content_hash", F.lit(True).alias("_workable"))
    retry = F.lit(True) if include_permanent else F.coalesce("retryable", F.lit(False))
    reopened = _update(
        queue.join(workable, ["job_id", "content_hash"], "left"),
        F.col("_workable") & (F.col("status") == "failed") & retry,
        {
            "status": F.lit("pending"),
            "attempts": F.lit(0),
            "started_at": _null(),
            "completed_at": _null(),
            "next_attempt_at": instant(as_of),
            "last_error": _null(),
            "error_class": _null(),
            "retryable": _null(),
        },
    )
    return reopened.select(*queue.columns)


# --- outcomes ---------------------------------------------------------------


def decide(batch: DataFrame, jobs: DataFrame, as_of) -> DataFrame:
    """Outcome of each claimed row before extraction, with its reason.

    stale, not_eligible, skipped_non_us, deferred_scope or apply; the first
    rule that holds wins.
    """
    current = jobs.select(
        "job_id", F.col("content_hash").alias("_hash"), "active", "enrichment_eligibility", "posted_at", "provider",
        "location", "raw_payload", "description_text", F.lit(True).alias("_exists"),
    )
    runtime = eligibility_reason(F.col("posted_at"), F.lit(None).cast("boolean"), as_of)
    stale = F.col("_exists").isNull() | ~F.col("_hash").eqNullSafe(F.col("content_hash"))
    blocked = ~F.col("enrichment_eligibility").eqNullSafe(F.lit("eligible")) | runtime.isNotNull()
    settled = F.when(stale, "stale").when(~F.col("active") | blocked, "not_eligible")
    items = batch.join(current, "job_id", "left").withColumn("_settled", settled)
    # Scope is only worked out for rows that get that far.
    for name in ("location", "raw_payload", "description_text"):
        items = items.withColumn(name, F.when(F.col("_settled").isNull(), F.col(name)))
    items = classify_scope(items)
    outcome = (
        F.when(F.col("_settled").isNotNull(), F.col("_settled"))
        .when(F.col("us_scope") == "non_us", "skipped_non_us")
        .when(F.col("us_scope") == "unknown", "deferred_scope")
        .otherwise("apply")
    )
    reason = (
        F.when(F.col("outcome") == "stale", "stale_content_hash")
        .when((F.col("outcome") == "not_eligible") & ~F.col("active"), "inactive")
        .when(F.col("outcome") == "not_eligible", F.coalesce(runtime, F.lit("not_eligible")))
        .otherwise(F.col("us_scope_reason"))
    )
    return (
        items.withColumn("outcome", outcome)
        .withColumn("outcome_reason", reason)
        .select(*batch.columns, "outcome", "outcome_reason")
    )


def run_batch(queue: DataFrame, jobs: DataFrame, as_of, budget: int, cut=None, **options) -> DataFrame:
    """Due rows, decided, up to the one that uses the last of the extraction budget.

    Only rows that reach extraction use the budget; rows settled before it
    (stale, not eligible, out of scope) are processed on the way.  ``cut``
    (``session.cut_lineage``) settles the decisions, which are read twice.
    """
    turn = F.struct("priority", "created_at", "queue_id")
    decided = decide(due(queue, jobs, as_of, **options), jobs, as_of).withColumn("_turn", turn)
    if cut is not None:
        decided = cut(decided)
    chosen = decided.filter(F.col("outcome") == "apply").select("_turn").orderBy("_turn").limit(budget)
    last = chosen.agg(F.max("_turn").alias("_last"), F.count(F.lit(1)).alias("_used"))
    within = (F.col("_used") < budget) | (F.col("_turn") <= F.col("_last"))
    return decided.join(F.broadcast(last), within).drop("_turn", "_last", "_used")


def attach_results(decided: DataFrame, results: DataFrame) -> DataFrame:
    """Final outcome once extraction results are known.

    ``results``: queue_id, is_valid, error, error_class, retryable,
    retry_after_seconds.  Rows to apply without a result stay as 'apply'.
    """
    columns = ("queue_id", "is_valid", "error", "error_class", "retryable", "retry_after_seconds")
    joined = decided.drop("error_class", "retryable").join(results.select(*columns), "queue_id", "left")
    applied = F.col("outcome") == "apply"
    outcome = F.when(applied & F.col("is_valid"), "completed").when(applied & ~F.col("is_valid"), "failed")
    return joined.withColumn("outcome", F.coalesce(outcome, F.col("outcome")))


def is_terminal(max_attempts: int = MAX_ATTEMPTS) -> Column:
    """No further attempt: attempts used up, or a failure that cannot be retried."""
    exhausted = F.col("attempts") >= max_attempts
    permanent = (F.col("outcome") == "failed") & ~F.coalesce("retryable", F.lit(True))
    return exhausted | permanent


def queue_outcomes(decided: DataFrame, as_of, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Queue values of each decided row after its outcome."""
    now = instant(as_of)
    outcome, terminal = F.col("outcome"), is_terminal(max_attempts)
    retried = outcome.isin("failed", "deferred_scope")
    delay = F.when(outcome == "failed", retry_delay_seconds(F.col("attempts"), F.col("retry_after_seconds"))).otherwise(
        F.lit(60.0 * DEFER_MINUTES)
    )
    later = F.timestamp_micros(F.unix_micros(now) + (delay * 1000000).cast("bigint"))
    status = (
        F.when(outcome.isin("stale", "completed"), "completed")
        .when(outcome.isin("not_eligible", "skipped_non_us"), "not_eligible")
        .when(retried & terminal, "failed")
        .when(retried, "pending")
        .otherwise("processing")
    )
    error = F.when(outcome == "failed", F.col("error")).when(
        outcome.isin("stale", "not_eligible", "deferred_scope"), F.col("outcome_reason")
    )
    return decided.select(
        "queue_id",
        status.alias("status"),
        error.alias("last_error"),
        F.when(outcome == "failed", F.col("error_class")).when(outcome == "deferred_scope", "unknown_scope").alias("error_class"),
        F.when(outcome == "failed", F.col("retryable")).when(outcome == "deferred_scope", F.lit(False)).alias("retryable"),
        F.when(retried & ~terminal, later).alias("next_attempt_at"),
        F.when((outcome != "apply") & (~retried | terminal), now).alias("completed_at"),
        _null().cast("timestamp").alias("started_at"),
        "outcome",
    )


def apply_queue_outcomes(queue: DataFrame, decided: DataFrame, as_of, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    changed = queue_outcomes(decided, as_of, max_attempts).filter(F.col("outcome") != "apply")
    return upsert(queue, changed, ["queue_id"])


def apply_job_outcomes(
    jobs: DataFrame, decided: DataFrame, as_of, schema_version: str = "v3", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Jobs after the outcomes; only rows whose content is still the queued one change."""
    facts = decided.select(
        "job_id", "content_hash", F.col("outcome").alias("_outcome"), F.col("outcome_reason").alias("_reason"),
        F.col("error").alias("_error"), is_terminal(max_attempts).alias("_terminal"),
    )
    joined = jobs.join(facts, ["job_id", "content_hash"], "left")
    outcome = F.col("_outcome")
    blocked = outcome.isin("not_eligible", "skipped_non_us")
    retried = F.when(F.col("_terminal"), "failed").otherwise("pending")
    updated = _update(
        joined,
        outcome.isNotNull() & ~outcome.isin("stale"),
        {
            "is_us_job": F.when(outcome.isin("completed", "apply", "failed"), True)
            .when(outcome == "skipped_non_us", False)
            .when(outcome == "not_eligible", F.col("is_us_job")),
            "us_location_reason": F.when(outcome == "not_eligible", F.col("us_location_reason")).otherwise(
                F.col("_reason")
            ),
            "classification_status": F.when(outcome == "completed", "ready")
            .when(blocked, "not_eligible")
            .when(outcome == "apply", "processing")
            .otherwise(retried),
            "classification_started_at": F.when(outcome == "apply", instant(as_of)),
            "classification_attempts": F.col("classification_attempts") + F.when(outcome == "failed", 1).otherwise(0),
            "classification_error": F.when(outcome == "failed", F.col("_error"))
            .when(outcome == "deferred_scope", F.col("_reason"))
            .when(outcome.isin("not_eligible", "apply"), F.col("classification_error")),
            "enrichment_eligibility": F.when(blocked, "not_eligible").otherwise(F.col("enrichment_eligibility")),
            "enrichment_eligibility_reason": F.when(outcome == "skipped_non_us", "non_us")
            .when(outcome == "not_eligible", F.col("_reason"))
            .otherwise(F.col("enrichment_eligibility_reason")),
            "classification_version": F.when(outcome == "completed", schema_version).otherwise(
                F.col("classification_version")
            ),
            "classified_at": F.when(outcome == "completed", instant(as_of)).otherwise(F.col("classified_at")),
            "classified_content_hash": F.when(outcome == "completed", F.col("content_hash")).otherwise(
                F.col("classified_content_hash")
            ),
        },
    )
    return updated.select(*jobs.columns)
