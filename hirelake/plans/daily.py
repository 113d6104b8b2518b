"""The daily run, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hirelake.operators import companies as company_ops
from hirelake.operators import enrich, lifecycle, queue as queue_ops, snapshots as snapshot_ops
from hirelake.operators.hiring_stats import hiring_stats
from hirelake.operators.joins import many_rows
from hirelake.sources.payloads import normalize_postings, raw_postings, split_boards, split_postings


@dataclass(frozen=True)
class CrawlOutput:
    result: lifecycle.CrawlResult
    companies: DataFrame
    quarantine: DataFrame


def crawl(
    boards: DataFrame, crawls: DataFrame, state: DataFrame, sources: DataFrame, companies: DataFrame,
    queue: DataFrame, as_of, cut=None, **options,
) -> CrawlOutput:
    """Board responses to the next state: normalise, assign companies, compare, record.

    A malformed response, or one with a posting that cannot be stored, is quarantined and
    its source's crawl counts as failed; other sources are not affected.  Pass
    ``cut`` (``session.cut_lineage``) for anything but tiny inputs: postings,
    companies and the diff each feed several outputs and are then computed once.
    """
    settle = (lambda df: many_rows(cut(df))) if cut else many_rows
    boards, crawls, state, sources, companies, queue = map(many_rows, (boards, crawls, state, sources, companies, queue))
    good, bad = split_boards(boards)
    batch, broken = split_postings(settle(normalize_postings(raw_postings(good)).drop("crawl_run_id")))
    bad = bad.unionByName(good.drop("postings").join(broken, "source_id"))
    failures = settle(bad.groupBy("source_id").agg(F.min("error").alias("error")))
    companies = settle(company_ops.ensure_companies(companies, batch, as_of, name="company"))
    batch = settle(company_ops.assign_companies(batch, sources, companies))
    known = crawls.drop("error", "status").join(failures, "source_id", "left")
    outcome = known.selectExpr("*", "CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status")
    linked = company_ops.link_sources(sources, batch)
    result = lifecycle.apply_crawl(state, batch, outcome, linked, queue, as_of, cut=cut and settle, **options)
    return CrawlOutput(result, companies, bad)


@dataclass(frozen=True)
class EnrichmentOutput:
    queue: DataFrame
    jobs: DataFrame
    enrichments: DataFrame
    decided: DataFrame


def enrich_run(
    queue: DataFrame, jobs: DataFrame, extracted: DataFrame, enrichments: DataFrame, as_of, budget: int, cut=None,
    **options,
) -> EnrichmentOutput:
    """One enrichment run over records that were already extracted.

    ``extracted``: queue_id, data (JSON text) or error with error_class,
    retryable and retry_after_seconds, plus model and token columns.
    """
    settle = cut or (lambda df: df)
    jobs = settle(queue_ops.expire_jobs(jobs, as_of))
    queue = settle(queue_ops.expire_queue(queue, jobs, as_of))
    batch = settle(queue_ops.run_batch(queue, jobs, as_of, budget, cut=cut, **options))
    claimed = queue_ops.mark_claimed(queue, batch, as_of)
    working = batch.withColumn("attempts", batch["attempts"] + 1)
    valid, rejected = enrich.split_checked(settle(enrich.check_records(extracted.filter("data IS NOT NULL"))))
    results = (
        valid.selectExpr(
            "queue_id", "true AS is_valid", "CAST(NULL AS STRING) AS error", "CAST(NULL AS STRING) AS error_class",
            "CAST(NULL AS BOOLEAN) AS retryable", "CAST(NULL AS DOUBLE) AS retry_after_seconds",
        )
        .unionByName(
            rejected.selectExpr(
                "queue_id", "false AS is_valid", "concat_ws(', ', errors) AS error",
                "'ValidationError' AS error_class", "false AS retryable", "CAST(NULL AS DOUBLE) AS retry_after_seconds",
            )
        )
        .unionByName(
            extracted.filter("data IS NULL").selectExpr(
                "queue_id", "false AS is_valid", "error", "error_class", "retryable", "retry_after_seconds"
            )
        )
    )
    decided = settle(queue_ops.attach_results(working, results))
    completed = decided.filter("outcome = 'completed'").select("queue_id", "job_id", "content_hash", "schema_version")
    facts = jobs.select(
        "job_id", "provider", "location", "employment_type", "workplace_type", "raw_payload", "description_text"
    )
    ready = settle(enrich.merge_trusted_facts(valid.join(completed, "queue_id").join(facts, "job_id")))
    return EnrichmentOutput(
        queue=queue_ops.apply_queue_outcomes(claimed, decided, as_of),
        jobs=enrich.apply_legacy(queue_ops.apply_job_outcomes(jobs, decided, as_of), ready),
        enrichments=enrich.upsert_enrichments(enrichments, enrich.enrichment_rows(ready, as_of)),
        decided=decided,
    )


@dataclass(frozen=True)
class DailyOutput:
    activity: DataFrame
    histograms: DataFrame
    stats: DataFrame


def publish_day(
    companies: DataFrame, jobs: DataFrame, events: DataFrame, enrichments: DataFrame, day, as_of
) -> DailyOutput:
    """Snapshot, histograms and statistics of one day."""
    records = snapshot_ops.current_records(jobs, enrichments)
    return DailyOutput(
        activity=snapshot_ops.daily_activity(companies, jobs, events, records, day),
        histograms=snapshot_ops.category_histograms(records, day),
        stats=hiring_stats(companies, jobs, as_of),
    )


def roll_day(
    previous: DailyOutput, companies: DataFrame, jobs: DataFrame, before: DataFrame, after: DataFrame, events: DataFrame,
    enrichments_before: DataFrame, enrichments_after: DataFrame, day, as_of,
) -> DailyOutput:
    """The next day from the one before and the rows that changed (see ``snapshots.roll_activity``)."""
    was, now = snapshot_ops.current_records(before, enrichments_before), snapshot_ops.current_records(after, enrichments_after)
    return DailyOutput(
        activity=snapshot_ops.roll_activity(previous.activity, companies, before, after, events, was, now, day),
        histograms=snapshot_ops.roll_histograms(previous.histograms, was, now, day),
        stats=hiring_stats(companies, jobs, as_of),
    )
