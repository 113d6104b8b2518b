"""Run observability: runs, stages, crawls, events and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import instant, seconds_between

ISSUE_SEVERITIES = ("critical", "error", "warning")
HEALTHY = ("success", "partial_success")


def duration_seconds(as_of) -> Column:
    """Elapsed seconds; a running row is measured up to ``as_of``."""
    return seconds_between(F.coalesce("finished_at", instant(as_of)), F.col("started_at")).cast("double")


def with_duration(rows: DataFrame, as_of) -> DataFrame:
    return rows.withColumn("duration_seconds", duration_seconds(as_of))


def _contains(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.strip().lower()))


def newest_runs(runs: DataFrame, as_of, limit: int = 25, offset: int = 0) -> DataFrame:
    ordered = with_duration(runs, as_of).orderBy(F.desc("started_at"), F.desc("run_id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def in_time_order(rows: DataFrame, time: str, key: str) -> DataFrame:
    return rows.orderBy(time, key)


def crawl_rows(crawls: DataFrame, sources: DataFrame, companies: DataFrame, as_of, run_id=None) -> DataFrame:
    """Crawls with their source and company."""
    if run_id is not None:
        crawls = crawls.filter(F.col("pipeline_run_id") == run_id)
    names = companies.select("company_id", F.col("name").alias("company_name"))
    known = sources.select("source_id", "provider", "canonical_url", "company_id")
    owners = known.join(names, "company_id", "left")
    return with_duration(crawls, as_of).join(owners, "source_id", "left")


def crawl_warned() -> Column:
    return (F.coalesce("warning", F.lit("")) != "") | F.coalesce("deactivation_skipped", F.lit(False))


def crawl_class() -> Column:
    failed = F.coalesce(F.col("status") == "failed", F.lit(False)) | (F.coalesce("error", F.lit("")) != "")
    return F.when(failed, "failed").when(crawl_warned(), "warning").otherwise("success")


def filter_crawls(crawls: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    if kind != "all":
        crawls = crawls.filter(crawl_class() == kind)
    if query.strip():
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("company_name", "provider", "canonical_url", "source_id")]
        crawls = crawls.filter(_contains(F.concat_ws(" ", *parts), query))
    return crawls


def filter_runs(runs: DataFrame, status: str = "all", query: str = "") -> DataFrame:
    if status != "all":
        runs = runs.filter(F.col("status") == status)
    if query.strip():
        label = F.concat(F.lit("#"), F.col("run_id").cast("string"), F.lit(" "), F.col("status"), F.lit(" "), F.coalesce("error", F.lit("")))
        runs = runs.filter(_contains(label, query))
    return runs


def filter_logs(logs: DataFrame, run_id=None, stage: str | None = None, level: str | None = None, query: str = "") -> DataFrame:
    if run_id is not None:
        logs = logs.filter(F.col("pipeline_run_id") == run_id)
    if stage is not None:
        logs = logs.filter(F.col("stage") == stage)
    if level is not None:
        logs = logs.filter(F.upper("level") == level.upper())
    if query.strip():
        text = F.concat_ws(" ", F.coalesce("logger", F.lit("")), "message", F.coalesce("exception", F.lit("")))
        logs = logs.filter(_contains(text, query))
    return logs


def issue_events(events: DataFrame, stage: str | None = None) -> DataFrame:
    rows = events.filter(F.col("severity").isin(*ISSUE_SEVERITIES))
    return rows if stage is None else rows.filter(F.col("stage") == stage)


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def run_history(runs: DataFrame) -> DataFrame:
    """Success rate over completed runs, their mean duration, and failures."""
    completed = F.col("status") != "running"
    done = F.count(F.when(completed, 1))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.when(done > 0, F.count(F.when(F.col("status") == "success", 1)) / done).alias("success_rate"),
        F.avg(F.when(completed, F.col("duration_seconds"))).alias("mean_duration_seconds"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_runs"),
    )


def failed_operations() -> Column:
    return F.coalesce("sources_failed", F.lit(0)) + F.coalesce("enrichments_failed", F.lit(0))


def _metric(metrics: Column, *paths: str) -> Column:
    values = [F.get_json_object(metrics, p).try_cast("double") for p in paths]
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])


def token_metrics(stages: DataFrame) -> DataFrame:
    """Token counts of a stage, under their own name or nested."""
    m = F.col("metrics")
    return stages.select(
        *stages.columns,
        _metric(m, "$.input_tokens", "$.tokens.input").alias("input_tokens"),
        _metric(m, "$.output_tokens", "$.tokens.output").alias("output_tokens"),
        _metric(m, "$.thought_tokens", "$.reasoning_tokens", "$.tokens.thought", "$.tokens.reasoning").alias("thought_tokens"),
        _metric(m, "$.cached_tokens", "$.tokens.cached").alias("cached_tokens"),
        _metric(m, "$.total_tokens", "$.tokens.total").alias("total_tokens"),
        F.coalesce(_metric(m, "$.ai_calls"), F.lit(0.0)).alias("ai_calls"),
        F.coalesce(_metric(m, "$.skipped_non_us"), F.lit(0.0)).alias("skipped_non_us"),
    )


def run_status(crawl_failures: Column, enrichment_failures: Column) -> Column:
    """A backlog alone does not make a run partial."""
    return F.when((crawl_failures > 0) | (enrichment_failures > 0), "partial_success").otherwise("success")


TOKENS = ("input_tokens", "output_tokens", "thought_tokens", "cached_tokens", "total_tokens")


def enrichment_summary(decided: DataFrame) -> DataFrame:
    """Outcome counts and token sums of a run (decided rows with usage columns).

    Tokens count wherever a call returned usage, also if its result was stale.
    """
    return decided.agg(*enrichment_figures())


def enrichment_figures() -> list[Column]:
    """The figures of ``enrichment_summary``, also for ``store.append_counted``."""
    outcome = F.col("outcome")

    def count(*names: str) -> Column:
        return F.count(F.when(outcome.isin(*names), 1))

    return [
        F.count(F.lit(1)).alias("processed"),
        count("completed", "failed").alias("model_calls"),
        count("completed", "skipped_non_us", "not_eligible").alias("completed"),
        count("failed").alias("failed"),
        count("stale").alias("stale"),
        count("skipped_non_us").alias("skipped_non_us"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS],
    ]


def has_usage() -> Column:
    return F.coalesce(*TOKENS).isNotNull()


def model_counts(decided: DataFrame) -> DataFrame:
    return (
        decided.filter(has_usage())
        .groupBy(F.coalesce("model", F.lit("unknown")).alias("model"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def system_health(runs: DataFrame, sources: DataFrame, queue: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: last run, active sources, pending queue rows, latest snapshot day."""
    last = runs.agg(F.max_by(F.struct("status", "finished_at"), F.struct("started_at", "run_id")).alias("r")).select(
        F.col("r.status").alias("last_pipeline_status"), F.col("r.finished_at").alias("last_pipeline_finish_time")
    )
    parts = (
        sources.agg(F.count(F.when(F.col("status") == "active", 1)).alias("active_source_count")),
        queue.agg(F.count(F.when(F.col("status") == "pending", 1)).alias("enrichment_backlog")),
        snapshots.agg(F.max("snapshot_date").alias("latest_snapshot_date")),
    )
    # Four one-row aggregates side by side.
    row = last.withColumn("_one", F.lit(1))
    for part in parts:
        row = row.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    healthy = F.coalesce(F.col("last_pipeline_status").isin(*HEALTHY), F.lit(False))
    return row.drop("_one").withColumn("status", F.when(healthy, "ok").otherwise("degraded"))
