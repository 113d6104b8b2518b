"""Daily company snapshots: activity counts and category histograms.

Histograms are kept in long form (company, day, dimension, name, count): it
aggregates with map-side combining, prunes by dimension and never builds a
company's whole vocabulary in one task.  Maps that come in from elsewhere are
unpacked to it; the largest entries are ranked in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.functions.scalar import comma_label, day as day_literal, nonblank_items

DIMENSIONS = ("role", "skill", "seniority", "location", "workplace", "domain")
ACTIVITY = ("total_open_jobs", "new_jobs", "removed_jobs", "changed_jobs", "enriched_jobs")


def open_us_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("active") & F.col("is_us_job"))


def is_baseline(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.baseline") == "true", F.lit(False))


def day_events(jobs: DataFrame, events: DataFrame, day) -> DataFrame:
    """New, removed and changed counts per company for one UTC day, US jobs only."""
    target = day_literal(day)
    start, end = target.cast("timestamp"), F.date_add(target, 1).cast("timestamp")
    kind = F.col("event_type")
    # Reduced to one row per job first: a busy job cannot unbalance the join.
    per_job = (
        events.filter((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
        .filter(kind.isin("created", "removed", "changed"))
        .groupBy("job_id")
        .agg(
            F.count(F.when((kind == "created") & ~is_baseline(F.col("metadata")), 1)).alias("new_jobs"),
            F.count(F.when(kind == "removed", 1)).alias("removed_jobs"),
            F.count(F.when(kind == "changed", 1)).alias("changed_jobs"),
        )
    )
    owners = jobs.filter("is_us_job").select("job_id", "company_id")
    return (
        per_job.join(owners, "job_id")
        .groupBy("company_id")
        .agg(*[F.sum(c).alias(c) for c in ("new_jobs", "removed_jobs", "changed_jobs")])
    )


def current_records(jobs: DataFrame, enrichments: DataFrame, schema_version: str = "v3") -> DataFrame:
    """Enrichment records of open US jobs that match the job's current content."""
    wanted = open_us_jobs(jobs).select("job_id", "content_hash", "company_id")
    return enrichments.filter(F.col("schema_version") == schema_version).join(wanted, ["job_id", "content_hash"])


def _labelled(dimension: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(dimension).alias("dimension"), n.alias("name")))


def _known(value: Column, drop_unknown: bool) -> Column:
    keep = value.isNotNull() & (value != "")
    return F.filter(F.array(value), lambda v: keep & (v != "unknown") if drop_unknown else keep)


def location_label(location: Column) -> Column:
    return comma_label(location["city"], location["state"], location["country"])


def category_labels() -> Column:
    """All (dimension, name) pairs one enrichment record counts towards."""
    # Explicit empty defaults: a missing list counts towards nothing.
    skills = F.array_distinct(F.concat(nonblank_items(F.col("required_skills")), nonblank_items(F.col("preferred_skills"))))
    places = F.filter(F.transform(F.col("locations"), location_label), lambda x: x.isNotNull())
    return F.concat(
        _labelled("role", _known(F.col("standardized_title"), False)),
        _labelled("skill", skills),
        _labelled("seniority", _known(F.col("seniority"), True)),
        _labelled("location", F.coalesce(places, F.array().cast("array<string>"))),
        _labelled("workplace", _known(F.col("workplace_type"), True)),
        _labelled("domain", nonblank_items(F.col("domain_tags"))),
    )


def category_histograms(records: DataFrame, day) -> DataFrame:
    """Long histograms: (company_id, snapshot_date, dimension, name, count)."""
    return (
        records.select("company_id", F.inline(category_labels()))
        .groupBy("company_id", "dimension", "name")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("snapshot_date", day_literal(day))
    )


def coverage(enriched: Column, total: Column) -> Column:
    return F.when(total != 0, enriched / total).otherwise(F.lit(0.0))


def daily_activity(
    companies: DataFrame, jobs: DataFrame, events: DataFrame, records: DataFrame, day
) -> DataFrame:
    """One activity row per company and day, zeros for companies without jobs."""
    open_counts = open_us_jobs(jobs).groupBy("company_id").agg(F.count(F.lit(1)).alias("total_open_jobs"))
    enriched = records.groupBy("company_id").agg(F.count(F.lit(1)).alias("enriched_jobs"))
    rows = companies.select("company_id")
    for part in (open_counts, day_events(jobs, events, day), enriched):
        rows = rows.join(part, "company_id", "left")
    return (
        rows.fillna(0, list(ACTIVITY))
        .withColumn("snapshot_date", day_literal(day))
        .withColumn("enrichment_coverage", coverage(F.col("enriched_jobs"), F.col("total_open_jobs")))
    )


def roll_histograms(previous: DataFrame, before: DataFrame, after: DataFrame, day) -> DataFrame:
    """A day's histograms from the previous day's and the records that changed.

    ``before`` has the records as they counted until then of jobs that were changed,
    closed or moved, ``after`` those that count from now on of jobs that were changed,
    opened or moved.  Records that stay as they are are not read: what no longer
    holds is retracted, what holds anew is added.
    """
    key = ["company_id", "dimension", "name"]

    def counted(records: DataFrame, sign: int) -> DataFrame:
        return records.select("company_id", F.inline(category_labels()), F.lit(sign).cast("bigint").alias("count"))

    entries = previous.select(*key, "count").unionByName(counted(before, -1)).unionByName(counted(after, 1))
    return entries.groupBy(*key).agg(F.sum("count").alias("count")).where("count <> 0").withColumn("snapshot_date", day_literal(day))


def roll_activity(
    previous: DataFrame, companies: DataFrame, before: DataFrame, after: DataFrame, events: DataFrame,
    records_before: DataFrame, records_after: DataFrame, day,
) -> DataFrame:
    """A day's activity from the previous day's: open and enriched jobs move by the
    jobs (and records) that changed, the other counts are the day's own.

    ``before`` and ``after`` are rows of every job with an event on the day, and of
    any other that changed, as they were and as they are.
    """

    def moved(rows: DataFrame, sign: int, name: str) -> DataFrame:
        return rows.groupBy("company_id").agg((F.count(F.lit(1)) * sign).alias(name))

    kept = previous.select("company_id", "total_open_jobs", "enriched_jobs")
    parts = [
        moved(open_us_jobs(before), -1, "total_open_jobs"),
        moved(open_us_jobs(after), 1, "total_open_jobs"),
        moved(records_before, -1, "enriched_jobs"),
        moved(records_after, 1, "enriched_jobs"),
        day_events(after, events, day),
    ]
    every = companies.select("company_id")
    # One aggregate over narrow rows in place of a join for each part.
    for part in [kept, *parts]:
        every = every.unionByName(part.join(companies.select("company_id"), "company_id", "left_semi"), allowMissingColumns=True)
    rows = every.groupBy("company_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ACTIVITY])
    return rows.withColumn("snapshot_date", day_literal(day)).withColumn(
        "enrichment_coverage", coverage(F.col("enriched_jobs"), F.col("total_open_jobs"))
    )


def unpack_histograms(snapshots: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Long form of map-typed snapshot columns, given as {column: dimension}."""
    def labelled(column: str, dimension: str) -> Column:
        pairs = F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,bigint>")))
        return F.transform(
            pairs,
            lambda e: F.struct(F.lit(dimension).alias("dimension"), e["key"].alias("name"), e["value"].alias("count")),
        )

    entries = F.concat(*[labelled(c, d) for c, d in columns.items()])
    return snapshots.select("company_id", "snapshot_date", F.inline(entries))


def top_entries(histograms: DataFrame, limit: int = 8) -> DataFrame:
    """The largest names of each company, day and dimension, ties by name.

    Ranks up to the limit are kept before the shuffle as well, so a company
    with a large vocabulary costs no more than its rows.
    """
    order = Window.partitionBy("company_id", "snapshot_date", "dimension").orderBy(F.col("count").desc(), "name")
    ranked = histograms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("company_id", "snapshot_date", "dimension", "rank", "name", "count")


def tracking_summary(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First, latest and number of snapshot days per company."""
    # Distinct days first, so the count needs no per-company set.
    days = snapshots.select("company_id", "snapshot_date").distinct()
    spans = days.groupBy("company_id").agg(
        F.min("snapshot_date").alias("first_snapshot_date"),
        F.max("snapshot_date").alias("latest_snapshot_date"),
        F.count(F.lit(1)).alias("snapshot_days"),
    )
    return (
        companies.select("company_id", "name", "tracking_started_at")
        .join(spans, "company_id", "left")
        .fillna(0, ["snapshot_days"])
    )


def backfill_tracking_start(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tracking starts at its recorded value, else the first job seen, else creation."""
    first = jobs.groupBy("company_id").agg(F.min("first_seen_at").alias("_first"))
    started = F.coalesce("tracking_started_at", "_first", "created_at")
    return companies.join(first, "company_id", "left").withColumn("tracking_started_at", started).drop("_first")
