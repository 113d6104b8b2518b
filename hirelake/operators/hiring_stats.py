"""Company hiring statistics from exact posting dates.

Jobs are reduced to one row per company before companies are joined, so a
company holding most of the jobs costs one partial aggregate per scan task and
the join only ever sees aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import instant, on_day
from hirelake.sources.store import upsert

COUNTS = (
    "current_open_jobs", "total_jobs_seen", "jobs_with_posted_at", "jobs_without_posted_at", "posted_today",
    "posted_yesterday", "posted_last_7_days", "posted_previous_7_days", "posted_last_15_days",
    "active_from_last_15_days", "removed_from_last_15_days", "active_30_plus_days", "active_45_plus_days",
    "active_90_plus_days",
)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def posting_counts(jobs: DataFrame, as_of) -> DataFrame:
    """Fourteen counts and three date bounds per company over confirmed US jobs."""
    now = instant(as_of)
    posted, active = F.col("posted_at"), F.col("active")

    def ago(days: int) -> Column:
        return now - F.expr(f"INTERVAL '{days}' DAY")

    last_15 = (posted >= ago(15)) & (posted <= now)
    today = F.to_date(now)
    return (
        jobs.filter(F.col("is_us_job") & F.col("company_id").isNotNull())
        .groupBy("company_id")
        .agg(
            _count(active).alias("current_open_jobs"),
            F.count(F.lit(1)).alias("total_jobs_seen"),
            F.count(posted).alias("jobs_with_posted_at"),
            _count(posted.isNull()).alias("jobs_without_posted_at"),
            _count(on_day(posted, today)).alias("posted_today"),
            _count(on_day(posted, F.date_sub(today, 1))).alias("posted_yesterday"),
            _count((posted >= ago(7)) & (posted <= now)).alias("posted_last_7_days"),
            _count((posted >= ago(14)) & (posted < ago(7))).alias("posted_previous_7_days"),
            _count(last_15).alias("posted_last_15_days"),
            _count(last_15 & active).alias("active_from_last_15_days"),
            _count(last_15 & ~active).alias("removed_from_last_15_days"),
            _count(active & (posted <= ago(30))).alias("active_30_plus_days"),
            _count(active & (posted <= ago(45))).alias("active_45_plus_days"),
            _count(active & (posted <= ago(90))).alias("active_90_plus_days"),
            F.max(posted).alias("latest_posted_at"),
            F.min(posted).alias("oldest_posted_at"),
            F.min(F.when(active, posted)).alias("oldest_active_posted_at"),
        )
    )


def _ratio(part: Column, whole: Column, factor: int, places: int, kind: str) -> Column:
    exact = part.cast("decimal(20,0)") * factor / whole.cast("decimal(20,0)")
    return F.when(whole != 0, F.round(exact, places).cast(kind))


def derive(stats: DataFrame) -> DataFrame:
    """Coverage, changes, growth and the publication flag."""
    seen, dated = F.col("total_jobs_seen"), F.col("jobs_with_posted_at")
    week, before = F.col("posted_last_7_days"), F.col("posted_previous_7_days")
    coverage = F.coalesce(_ratio(dated, seen, 1, 4, "decimal(6,4)"), F.lit(0).cast("decimal(6,4)"))
    return stats.select(
        "*",
        coverage.alias("posted_at_coverage"),
        (F.col("posted_today") - F.col("posted_yesterday")).alias("daily_change"),
        (week - before).alias("weekly_change"),
        _ratio(week - before, before, 100, 2, "decimal(12,2)").alias("weekly_growth_percent"),
        (dated > 0).alias("is_publishable"),
        F.when(seen == 0, "no_jobs_seen").when(dated == 0, "no_exact_posted_dates").alias("publishable_reason"),
    )


def hiring_stats(companies: DataFrame, jobs: DataFrame, as_of, company_id=None) -> DataFrame:
    """One statistics row per company, zero rows included; optionally one company only."""
    if company_id is not None:
        companies = companies.filter(F.col("company_id") == company_id)
        jobs = jobs.filter(F.col("company_id") == company_id)
    counted = companies.select("company_id").join(posting_counts(jobs, as_of), "company_id", "left")
    return derive(counted.fillna(0, list(COUNTS))).withColumn("calculated_at", instant(as_of))


def strict_publishability(
    stats: DataFrame, companies: DataFrame, as_of, min_tracking_days: int = 15, min_coverage: float = 0.80
) -> DataFrame:
    """The older publication rule: enough tracked days and enough dated jobs."""
    started = companies.select("company_id", "tracking_started_at")
    tracked = F.coalesce(
        F.greatest(F.lit(0), F.datediff(F.to_date(instant(as_of)), F.to_date("tracking_started_at"))), F.lit(0)
    )
    dated, coverage = F.col("jobs_with_posted_at"), F.col("posted_at_coverage")
    floor = F.lit(str(min_coverage)).cast("decimal(6,4)")
    return (
        stats.drop("is_publishable", "publishable_reason")
        .join(started, "company_id", "left")
        .withColumn("tracking_days", tracked)
        .withColumn(
            "is_publishable", (F.col("tracking_days") >= min_tracking_days) & (dated > 0) & (coverage >= floor)
        )
        .withColumn(
            "publishable_reason",
            F.when(F.col("total_jobs_seen") == 0, "no_jobs_seen")
            .when(F.col("tracking_days") < min_tracking_days, f"tracking_under_{min_tracking_days}_days")
            .when(dated == 0, "no_exact_posted_dates")
            .when(coverage < floor, f"posted_at_coverage_below_{round(min_coverage * 100)}_percent"),
        )
        .drop("tracking_started_at")
    )


def publishable_counts(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("companies_refreshed"),
        _count(F.col("is_publishable")).alias("publishable_companies"),
        _count(~F.col("is_publishable")).alias("unpublishable_companies"),
    )


# --- reading the statistics -------------------------------------------------


def published(companies: DataFrame, stats: DataFrame) -> DataFrame:
    """Companies with publishable statistics."""
    return companies.select("company_id", "name", "slug", "website_domain").join(
        stats.filter("is_publishable"), "company_id"
    )


def list_companies(companies: DataFrame, stats: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the company list, busiest first."""
    ranked = published(companies, stats).orderBy(
        F.desc("posted_last_7_days"), F.desc("current_open_jobs"), "name", "company_id"
    )
    return ranked.offset(offset).limit(limit) if offset else ranked.limit(limit)


def count_published(companies: DataFrame, stats: DataFrame) -> DataFrame:
    """The total beside a page of the company list."""
    return published(companies, stats).agg(F.count(F.lit(1)).alias("total"))


def merge_stats(stored: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Stored statistics with those of refreshed companies (one or all) put in."""
    return upsert(stored, refreshed, ["company_id"])


def momentum() -> Column:
    growth = F.coalesce(F.col("weekly_growth_percent"), F.lit(0).cast("decimal(12,2)"))
    week, before, change = F.col("posted_last_7_days"), F.col("posted_previous_7_days"), F.col("weekly_change")
    fresh = F.col("weekly_growth_percent").isNull() & (week > 0) & (before == 0)
    return (
        F.when(fresh, "new_momentum")
        .when((growth >= 10) | (change >= 3), "growing")
        .when((growth <= -10) | (change <= -3), "cooling")
        .otherwise("stable")
    )


def is_stale_inventory() -> Column:
    old, open_jobs = F.col("active_45_plus_days"), F.col("current_open_jobs")
    share = F.when(open_jobs != 0, old / open_jobs).otherwise(0.0)
    return (old >= 5) & (share >= 0.25)


# Sort keys of the dashboard; each is descending with unknown values last, then by name.
DASHBOARD_SORTS = {
    "activity": "posted_last_7_days",
    "open": "current_open_jobs",
    "today": "posted_today",
    "growth": "weekly_growth_percent",
    "aging": "active_30_plus_days",
}


def dashboard(
    companies: DataFrame,
    query: str = "",
    publishable_only: bool = True,
    trend: str = "all",
    min_coverage: float = 0.0,
    sort: str = "activity",
    limit: int | None = None,
) -> DataFrame:
    """Filtered and sorted company dashboard rows (input: companies with statistics)."""
    rows = companies.withColumn("momentum", momentum()).withColumn("stale_inventory", is_stale_inventory())
    needle = query.strip().lower()
    if needle:
        haystack = F.lower(F.concat(F.col("name"), F.lit(" "), F.coalesce("website_domain", F.lit(""))))
        rows = rows.filter(F.contains(haystack, F.lit(needle)))
    if publishable_only:
        rows = rows.filter("is_publishable")
    if trend == "growing":
        rows = rows.filter(F.col("momentum").isin("growing", "new_momentum"))
    elif trend != "all":
        rows = rows.filter(F.col("momentum") == trend)
    rows = rows.filter(F.col("posted_at_coverage") >= min_coverage)
    order = [F.asc("name")] if sort == "name" else [F.desc_nulls_last(DASHBOARD_SORTS[sort]), F.asc("name")]
    rows = rows.orderBy(*order, "company_id")
    return rows if limit is None else rows.limit(limit)


def dashboard_totals(companies: DataFrame) -> DataFrame:
    def total(name: str, alias: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(alias)

    return companies.agg(
        total("current_open_jobs", "open"),
        total("posted_today", "today"),
        total("posted_last_7_days", "week"),
        total("active_30_plus_days", "aging"),
        _count(F.col("is_publishable")).alias("publishable"),
    )
