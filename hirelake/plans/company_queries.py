"""Company statistics, snapshots and trends over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import hiring_stats as stats_ops, snapshots as snap, trends as trend
from hirelake.plans.registry import query
from hirelake.session import scratch
from hirelake.sources import store
from hirelake.plans.standins import (
    EVENTS_AS_OF,
    EVENTS_LATE_AS_OF,
    ORDERS_AS_OF,
    cte,
    histograms,
    plain,
    snapshots,
    standin,
    table,
)


# --- hiring statistics ------------------------------------------------------

TS = "%Y-%m-%d %H:%M:%S"


def stats_sql(companies: str, jobs: str, as_of: str, extra: str = "") -> str:
    """Statistics per company in SQL; ratios use exact integer half-up rounding."""
    t = f"TIMESTAMP '{as_of}'"
    return (
        cte(companies, jobs)
        + f""", agg AS (
  SELECT c.company_id,
    count(j.job_id) FILTER (WHERE j.active) AS current_open_jobs,
    count(j.job_id) AS total_jobs_seen,
    count(j.job_id) FILTER (WHERE j.posted_at IS NOT NULL) AS jobs_with_posted_at,
    count(j.job_id) FILTER (WHERE j.posted_at IS NULL) AS jobs_without_posted_at,
    count(j.job_id) FILTER (WHERE CAST(j.posted_at AS DATE) = CAST({t} AS DATE)) AS posted_today,
    count(j.job_id) FILTER (WHERE CAST(j.posted_at AS DATE) = CAST({t} AS DATE) - 1) AS posted_yesterday,
    count(j.job_id) FILTER (WHERE j.posted_at BETWEEN {t} - INTERVAL 7 DAY AND {t}) AS posted_last_7_days,
    count(j.job_id) FILTER (WHERE j.posted_at >= {t} - INTERVAL 14 DAY AND j.posted_at < {t} - INTERVAL 7 DAY) AS posted_previous_7_days,
    count(j.job_id) FILTER (WHERE j.posted_at BETWEEN {t} - INTERVAL 15 DAY AND {t}) AS posted_last_15_days,
    count(j.job_id) FILTER (WHERE j.active AND j.posted_at BETWEEN {t} - INTERVAL 15 DAY AND {t}) AS active_from_last_15_days,
    count(j.job_id) FILTER (WHERE NOT j.active AND j.posted_at BETWEEN {t} - INTERVAL 15 DAY AND {t}) AS removed_from_last_15_days,
    count(j.job_id) FILTER (WHERE j.active AND j.posted_at <= {t} - INTERVAL 30 DAY) AS active_30_plus_days,
    count(j.job_id) FILTER (WHERE j.active AND j.posted_at <= {t} - INTERVAL 45 DAY) AS active_45_plus_days,
    count(j.job_id) FILTER (WHERE j.active AND j.posted_at <= {t} - INTERVAL 90 DAY) AS active_90_plus_days,
    max(j.posted_at) AS latest_posted_at, min(j.posted_at) AS oldest_posted_at,
    min(j.posted_at) FILTER (WHERE j.active) AS oldest_active_posted_at
  FROM {companies} c LEFT JOIN {jobs} j ON j.company_id = c.company_id AND j.is_us_job IS TRUE
  GROUP BY c.company_id
), stats AS (
  SELECT *,
    CASE WHEN total_jobs_seen = 0 THEN 0.0
         ELSE ((jobs_with_posted_at * 20000 + total_jobs_seen) // (2 * total_jobs_seen)) / 10000.0 END AS posted_at_coverage,
    posted_today - posted_yesterday AS daily_change,
    posted_last_7_days - posted_previous_7_days AS weekly_change,
    CASE WHEN posted_previous_7_days > 0 THEN
      sign(posted_last_7_days - posted_previous_7_days)
      * ((abs(posted_last_7_days - posted_previous_7_days) * 20000 + posted_previous_7_days) // (2 * posted_previous_7_days)) / 100.0
    END AS weekly_growth_percent,
    jobs_with_posted_at > 0 AS is_publishable,
    CASE WHEN total_jobs_seen = 0 THEN 'no_jobs_seen' WHEN jobs_with_posted_at = 0 THEN 'no_exact_posted_dates' END AS publishable_reason
  FROM agg
)"""
        + extra
    )


_STATS_COLUMNS = (
    "company_id, current_open_jobs, total_jobs_seen, jobs_with_posted_at, jobs_without_posted_at, posted_today, "
    "posted_yesterday, posted_last_7_days, posted_previous_7_days, posted_last_15_days, active_from_last_15_days, "
    "removed_from_last_15_days, active_30_plus_days, active_45_plus_days, active_90_plus_days, "
    f"strftime(latest_posted_at, '{TS}') AS latest_posted_at, strftime(oldest_posted_at, '{TS}') AS oldest_posted_at, "
    f"strftime(oldest_active_posted_at, '{TS}') AS oldest_active_posted_at, "
    "CAST(posted_at_coverage AS DOUBLE) AS posted_at_coverage, daily_change, weekly_change, "
    "CAST(weekly_growth_percent AS DOUBLE) AS weekly_growth_percent, is_publishable, publishable_reason"
)


def event_stats(spark, sf, as_of=EVENTS_AS_OF):
    return stats_ops.hiring_stats(standin(spark, sf, "companies"), standin(spark, sf, "jobs"), as_of)


def order_stats(spark, sf):
    return stats_ops.hiring_stats(standin(spark, sf, "sparse_companies"), standin(spark, sf, "order_jobs"), ORDERS_AS_OF)


@query("a01_hiring_stats", stats_sql("companies", "jobs", EVENTS_AS_OF) + f" SELECT {_STATS_COLUMNS} FROM stats")
def a01(spark, sf):
    return plain(event_stats(spark, sf).drop("calculated_at"))


@query("a01_hiring_stats_aged", stats_sql("companies", "jobs", EVENTS_LATE_AS_OF) + f" SELECT {_STATS_COLUMNS} FROM stats")
def a01_aged(spark, sf):
    return plain(event_stats(spark, sf, EVENTS_LATE_AS_OF).drop("calculated_at"))


@query(
    "a02_hiring_stats_sparse",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF) + f" SELECT {_STATS_COLUMNS} FROM stats",
)
def a02(spark, sf):
    return plain(order_stats(spark, sf).drop("calculated_at"))


_ITEM_SQL = f"""
SELECT s_suppkey AS company_id, count(l_suppkey) AS total_jobs_seen,
  count(*) FILTER (WHERE l_linestatus = 'O') AS current_open_jobs,
  count(*) FILTER (WHERE l_shipdate BETWEEN TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{ORDERS_AS_OF}') AS posted_last_7_days,
  count(*) FILTER (WHERE l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS active_90_plus_days,
  strftime(max(l_shipdate), '{TS}') AS latest_posted_at
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"""


@query("j01_company_jobs_bench", _ITEM_SQL)
def j01(spark, sf):
    from hirelake.plans.standins import table

    companies = table(spark, sf, "supplier").selectExpr("s_suppkey AS company_id")
    jobs = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS company_id", "l_shipdate AS posted_at", "l_linestatus = 'O' AS active", "true AS is_us_job"
    )
    stats = stats_ops.hiring_stats(companies, jobs, ORDERS_AS_OF)
    return plain(
        stats.select(
            "company_id", "total_jobs_seen", "current_open_jobs", "posted_last_7_days", "active_90_plus_days",
            "latest_posted_at",
        )
    )


@query(
    "c14_strict_publishability",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + f"""
, tracked AS (
  SELECT s.*, CASE WHEN c.tracking_started_at IS NULL THEN 0
    ELSE greatest(0, date_diff('day', CAST(c.tracking_started_at AS DATE), DATE '{ORDERS_AS_OF[:10]}')) END AS tracking_days
  FROM stats s JOIN sparse_companies c USING (company_id))
SELECT company_id, CAST(tracking_days AS BIGINT) AS tracking_days,
  tracking_days >= 15 AND jobs_with_posted_at > 0 AND posted_at_coverage >= 0.8 AS is_publishable,
  CASE WHEN total_jobs_seen = 0 THEN 'no_jobs_seen' WHEN tracking_days < 15 THEN 'tracking_under_15_days'
    WHEN jobs_with_posted_at = 0 THEN 'no_exact_posted_dates'
    WHEN posted_at_coverage < 0.8 THEN 'posted_at_coverage_below_80_percent' END AS publishable_reason
FROM tracked""",
)
def c14(spark, sf):
    strict = stats_ops.strict_publishability(order_stats(spark, sf), standin(spark, sf, "sparse_companies"), ORDERS_AS_OF)
    return plain(strict.select("company_id", "tracking_days", "is_publishable", "publishable_reason"))


@query(
    "a17_publishable_counts",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + " SELECT count(*) AS companies_refreshed, count(*) FILTER (WHERE is_publishable) AS publishable_companies, "
    "count(*) FILTER (WHERE NOT is_publishable) AS unpublishable_companies FROM stats",
)
def a17(spark, sf):
    return stats_ops.publishable_counts(order_stats(spark, sf))


_LIST = "company_id, name, slug, website_domain, current_open_jobs, posted_last_7_days, total_jobs_seen"


@query(
    "o1_company_list",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + f""" SELECT {_LIST} FROM sparse_companies JOIN stats USING (company_id) WHERE is_publishable
ORDER BY posted_last_7_days DESC, current_open_jobs DESC, name, company_id LIMIT 50 OFFSET 10""",
)
def o1(spark, sf):
    ranked = stats_ops.list_companies(standin(spark, sf, "sparse_companies"), order_stats(spark, sf), 50, 10)
    return plain(ranked.select(*_LIST.split(", ")))


@query(
    "o1_company_total",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + " SELECT count(*) AS total FROM sparse_companies JOIN stats USING (company_id) WHERE is_publishable",
)
def o1_total(spark, sf):
    return stats_ops.count_published(standin(spark, sf, "sparse_companies"), order_stats(spark, sf))


_REFRESHED = "company_id, current_open_jobs, total_jobs_seen, posted_today, posted_last_7_days, active_30_plus_days, is_publishable"


@query(
    "s13_one_company_refreshed",
    "SELECT * FROM ("
    + stats_sql("companies", "jobs", EVENTS_AS_OF)
    + f" SELECT {_REFRESHED} FROM companies JOIN stats USING (company_id)) WHERE company_id <> 7 UNION ALL SELECT * FROM ("
    + stats_sql("companies", "jobs", EVENTS_LATE_AS_OF)
    + f" SELECT {_REFRESHED} FROM companies JOIN stats USING (company_id)) WHERE company_id = 7",
)
def s13(spark, sf):
    companies, jobs = standin(spark, sf, "companies"), standin(spark, sf, "jobs")
    later = stats_ops.hiring_stats(companies, jobs, EVENTS_LATE_AS_OF, 7)
    merged = stats_ops.merge_stats(event_stats(spark, sf), later)
    return plain(merged.select(*_REFRESHED.split(", ")))


# Snapshot days stored, then two of them computed anew and published again.
_REWRITTEN = "snapshot_date IN (DATE '2024-01-10', DATE '2024-01-11')"


@query(
    "s12_published_days",
    cte("snapshots")
    + f"""SELECT company_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date,
  total_open_jobs + CASE WHEN {_REWRITTEN} THEN 1000 ELSE 0 END AS total_open_jobs, new_jobs
FROM snapshots WHERE NOT ({_REWRITTEN} AND company_id % 2 = 0)""",
)
def s12(spark, sf):
    days = snapshots(spark, sf).select("company_id", "snapshot_date", "total_open_jobs", "new_jobs")
    path = scratch(spark, "snapshots")
    store.publish_days(days, path)
    again = days.where(f"{_REWRITTEN} AND company_id % 2 = 1").withColumn("total_open_jobs", F.col("total_open_jobs") + 1000)
    store.publish_days(again, path)
    schema = "company_id bigint, total_open_jobs bigint, new_jobs bigint, snapshot_date date"
    return plain(store.read_rows(spark, path, schema))


@query(
    "s14_appended_rows",
    cte("job_events") + "SELECT job_id, event_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, metadata FROM job_events",
)
def s14(spark, sf):
    events, path = standin(spark, sf, "job_events"), scratch(spark, "events")
    events = events.withColumn("occurred_on", F.to_date("occurred_at"))
    # Two crawls' rows, appended one after the other to the same days.
    for half in (0, 1):
        store.append_rows(events.where(F.pmod("job_id", F.lit(2)) == half), path, "occurred_on")
    schema = "job_id bigint, event_type string, occurred_at timestamp, metadata string, occurred_on date"
    return plain(store.read_rows(spark, path, schema).drop("occurred_on"))


@query(
    "j20_published_companies",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + f" SELECT {_LIST} FROM sparse_companies JOIN stats USING (company_id) WHERE is_publishable",
)
def j20(spark, sf):
    published = stats_ops.published(standin(spark, sf, "sparse_companies"), order_stats(spark, sf))
    return plain(published.select(*_LIST.split(", ")))


_MOMENTUM_SQL = """, board AS (
  SELECT c.name, c.website_domain, s.*,
    CASE WHEN weekly_growth_percent IS NULL AND posted_last_7_days > 0 AND posted_previous_7_days = 0 THEN 'new_momentum'
      WHEN coalesce(weekly_growth_percent, 0) >= 10 OR weekly_change >= 3 THEN 'growing'
      WHEN coalesce(weekly_growth_percent, 0) <= -10 OR weekly_change <= -3 THEN 'cooling' ELSE 'stable' END AS momentum,
    active_45_plus_days >= 5 AND current_open_jobs > 0 AND active_45_plus_days / CAST(current_open_jobs AS DOUBLE) >= 0.25 AS stale_inventory
  FROM companies_in c JOIN stats s USING (company_id) WHERE is_publishable)"""


def board(spark, sf):
    return stats_ops.published(
        standin(spark, sf, "companies"), event_stats(spark, sf, EVENTS_LATE_AS_OF)
    )


def board_sql(as_of: str) -> str:
    return stats_sql("companies", "jobs", as_of) + _MOMENTUM_SQL.replace("companies_in", "companies")


@query(
    "c02_momentum_and_stale_inventory",
    board_sql(EVENTS_AS_OF) + " SELECT company_id, momentum, stale_inventory FROM board",
)
def c02(spark, sf):
    published = stats_ops.published(standin(spark, sf, "companies"), event_stats(spark, sf))
    return published.select(
        "company_id", stats_ops.momentum().alias("momentum"), stats_ops.is_stale_inventory().alias("stale_inventory")
    )


@query(
    "c03_stale_inventory_sparse",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + """ SELECT company_id, active_45_plus_days >= 5 AND current_open_jobs > 0
  AND active_45_plus_days / CAST(current_open_jobs AS DOUBLE) >= 0.25 AS stale_inventory FROM stats""",
)
def c03(spark, sf):
    return order_stats(spark, sf).select("company_id", stats_ops.is_stale_inventory().alias("stale_inventory"))


@query(
    "f14_company_dashboard",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + _MOMENTUM_SQL.replace("companies_in", "sparse_companies")
    + """ SELECT company_id, name, momentum, stale_inventory, CAST(weekly_growth_percent AS DOUBLE) AS weekly_growth_percent
FROM board WHERE contains(lower(name || ' ' || coalesce(website_domain, '')), 'building') AND momentum = 'stable'
  AND posted_at_coverage >= 0.75""",
)
def f14(spark, sf):
    rows = stats_ops.published(standin(spark, sf, "sparse_companies"), order_stats(spark, sf))
    found = stats_ops.dashboard(rows, " Building ", trend="stable", min_coverage=0.75, sort="growth")
    return plain(found.select("company_id", "name", "momentum", "stale_inventory", "weekly_growth_percent"))


@query(
    "o5_dashboard_by_growth",
    stats_sql("sparse_companies", "order_jobs", ORDERS_AS_OF)
    + _MOMENTUM_SQL.replace("companies_in", "sparse_companies")
    + """ SELECT company_id, name, CAST(weekly_growth_percent AS DOUBLE) AS weekly_growth_percent FROM board
ORDER BY weekly_growth_percent DESC NULLS LAST, name, company_id LIMIT 25""",
)
def o5(spark, sf):
    rows = stats_ops.published(standin(spark, sf, "sparse_companies"), order_stats(spark, sf))
    top = stats_ops.dashboard(rows, sort="growth", limit=25)
    return plain(top.select("company_id", "name", "weekly_growth_percent"))


@query(
    "a21_dashboard_totals",
    board_sql(EVENTS_LATE_AS_OF)
    + """ SELECT CAST(sum(current_open_jobs) AS BIGINT) AS open, CAST(sum(posted_today) AS BIGINT) AS today,
  CAST(sum(posted_last_7_days) AS BIGINT) AS week, CAST(sum(active_30_plus_days) AS BIGINT) AS aging,
  count(*) FILTER (WHERE is_publishable) AS publishable FROM board""",
)
def a21(spark, sf):
    return stats_ops.dashboard_totals(board(spark, sf))


# --- snapshots --------------------------------------------------------------

_DAY = "2024-01-24"


@query(
    "a03_daily_activity",
    cte("companies", "jobs", "job_events")
    + f"""SELECT *, CASE WHEN total_open_jobs > 0 THEN enriched_jobs / total_open_jobs ELSE 0 END AS enrichment_coverage FROM (
SELECT c.company_id, '{_DAY}' AS snapshot_date,
  (SELECT count(*) FROM jobs j WHERE j.company_id = c.company_id AND j.active AND j.is_us_job) AS total_open_jobs,
  count(e.job_id) FILTER (WHERE e.event_type = 'created' AND json_extract_string(e.metadata, '$.baseline') IS DISTINCT FROM 'true') AS new_jobs,
  count(e.job_id) FILTER (WHERE e.event_type = 'removed') AS removed_jobs,
  count(e.job_id) FILTER (WHERE e.event_type = 'changed') AS changed_jobs,
  (SELECT count(*) FROM jobs j WHERE j.company_id = c.company_id AND j.active AND j.is_us_job AND j.k < 40) AS enriched_jobs
FROM companies c LEFT JOIN jobs j ON j.company_id = c.company_id AND j.is_us_job
LEFT JOIN job_events e ON e.job_id = j.job_id AND CAST(e.occurred_at AS DATE) = DATE '{_DAY}'
GROUP BY c.company_id)""",
)
def a03(spark, sf):
    jobs = standin(spark, sf, "jobs")
    # Records of some jobs, a part of them of older content, and one schema too many.
    enrichments = jobs.filter("k < 70").selectExpr(
        "job_id",
        "CASE WHEN k < 40 OR k >= 60 THEN content_hash ELSE 'older' END AS content_hash",
        "CASE WHEN k < 60 THEN 'v3' ELSE 'v2' END AS schema_version",
    )
    records = snap.current_records(jobs, enrichments)
    rows = snap.daily_activity(standin(spark, sf, "companies"), jobs, standin(spark, sf, "job_events"), records, _DAY)
    return plain(
        rows.select(
            "company_id", "snapshot_date", "total_open_jobs", "new_jobs", "removed_jobs", "changed_jobs", "enriched_jobs",
            "enrichment_coverage",
        )
    )


def order_records(spark, sf):
    records = standin(spark, sf, "enrichments")
    # Exactly one location per record, given as its parts.
    places = F.array(F.struct("city", "state", "country"))
    return snap.current_records(standin(spark, sf, "order_jobs"), records.withColumn("locations", places))


_RECORDS_SQL = cte("order_jobs", "enrichments") + """, records AS (
  SELECT e.*, j.company_id FROM enrichments e JOIN order_jobs j USING (job_id, content_hash)
  WHERE j.active AND j.is_us_job AND e.schema_version = 'v3')"""


_HISTOGRAMS_SQL = (
    _RECORDS_SQL
    + f""", named AS (
  SELECT company_id, 'role' AS dimension, standardized_title AS name FROM records
  UNION ALL SELECT company_id, 'skill', unnest(list_distinct(list_filter(list_concat(required_skills, preferred_skills), lambda x: trim(x) <> ''))) FROM records
  UNION ALL SELECT company_id, 'seniority', seniority FROM records WHERE seniority <> 'unknown'
  UNION ALL SELECT company_id, 'location', concat_ws(', ', city, state, country) FROM records WHERE city IS NOT NULL
  UNION ALL SELECT company_id, 'workplace', workplace_type FROM records WHERE workplace_type <> 'unknown'
  UNION ALL SELECT company_id, 'domain', unnest(list_filter(domain_tags, lambda x: trim(x) <> '')) FROM records)
SELECT company_id, dimension, name, count(*) AS count, '{_DAY}' AS snapshot_date FROM named GROUP BY ALL"""
)


@query("a04_category_histograms", _HISTOGRAMS_SQL)
def a04(spark, sf):
    return plain(snap.category_histograms(order_records(spark, sf), _DAY))


@query("a04_rolled_histograms", _HISTOGRAMS_SQL)
def a04_rolled(spark, sf):
    """The same histograms, rolled forward from a day on which some records were others."""
    records = order_records(spark, sf)
    other, opened, closed = (f"pmod(hash(company_id, standardized_title, seniority, {k}), 5) = 0" for k in (1, 2, 3))
    was = records.withColumn("standardized_title", F.lit("an earlier title")).withColumn("domain_tags", F.array(F.lit("earlier"), F.lit(" ")))
    gone = records.where(closed).withColumn("company_id", F.col("company_id") + 1)
    before = was.where(f"{other} AND NOT {opened}").unionByName(gone)
    known = records.where(f"NOT ({other}) AND NOT ({opened})").unionByName(before)
    after = records.where(f"{other} OR {opened}")
    return plain(snap.roll_histograms(snap.category_histograms(known, "1998-01-01"), before, after, _DAY))


@query(
    "a05_enrichment_coverage",
    _RECORDS_SQL
    + """SELECT c.company_id, coalesce(n, 0) AS enriched_jobs, coalesce(o, 0) AS total_open_jobs,
  CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE coalesce(n, 0) / CAST(o AS DOUBLE) END AS enrichment_coverage
FROM (SELECT c_custkey AS company_id FROM customer) c
LEFT JOIN (SELECT company_id, count(*) AS n FROM records GROUP BY 1) r USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS o FROM order_jobs WHERE active AND is_us_job GROUP BY 1) p USING (company_id)""",
)
def a05(spark, sf):
    jobs = standin(spark, sf, "order_jobs")
    events = standin(spark, sf, "order_events").withColumn("metadata", F.lit("{}"))
    rows = snap.daily_activity(
        standin(spark, sf, "sparse_companies"), jobs, events, order_records(spark, sf), ORDERS_AS_OF[:10]
    )
    return rows.select("company_id", "enriched_jobs", "total_open_jobs", "enrichment_coverage")


@query(
    "a11_tracking_summary",
    cte("companies", "snapshots")
    + f"""SELECT c.company_id, c.name, strftime(c.tracking_started_at, '{TS}') AS tracking_started_at,
  CAST(min(snapshot_date) AS VARCHAR) AS first_snapshot_date, CAST(max(snapshot_date) AS VARCHAR) AS latest_snapshot_date,
  count(DISTINCT snapshot_date) AS snapshot_days
FROM companies c LEFT JOIN snapshots s USING (company_id) GROUP BY 1, 2, c.tracking_started_at""",
)
def a11(spark, sf):
    return plain(snap.tracking_summary(standin(spark, sf, "companies"), snapshots(spark, sf)))


@query(
    "l27_tracking_start",
    cte("companies", "jobs")
    + f"""SELECT c.company_id, strftime(coalesce(c.tracking_started_at, min(j.first_seen_at), c.created_at), '{TS}') AS tracking_started_at
FROM companies c LEFT JOIN jobs j USING (company_id) GROUP BY c.company_id, c.tracking_started_at, c.created_at""",
)
def l27(spark, sf):
    rows = snap.backfill_tracking_start(standin(spark, sf, "companies"), standin(spark, sf, "jobs"))
    return plain(rows.select("company_id", "tracking_started_at"))


# --- trends -----------------------------------------------------------------

_MARKET = "total_open_jobs, new_jobs, removed_jobs, changed_jobs, enriched_jobs"
_MARKET_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _MARKET.split(", "))


@query(
    "a06_market_snapshot",
    cte("snapshots")
    + f"""SELECT CAST(t.day AS VARCHAR) AS snapshot_date, count(s.company_id) AS companies_tracked, {_MARKET_SUMS}
FROM (SELECT max(snapshot_date) AS day FROM snapshots) t LEFT JOIN snapshots s ON s.snapshot_date = t.day GROUP BY t.day""",
)
def a06(spark, sf):
    return plain(trend.market_snapshot(snapshots(spark, sf)))


@query(
    "j11_market_snapshot_empty_day",
    cte("snapshots")
    + f"""SELECT CAST(t.day AS VARCHAR) AS snapshot_date, count(s.company_id) AS companies_tracked, {_MARKET_SUMS}
FROM (SELECT DATE '2030-01-01' AS day) t LEFT JOIN snapshots s ON s.snapshot_date = t.day GROUP BY t.day""",
)
def j11(spark, sf):
    return plain(trend.market_snapshot(snapshots(spark, sf), "2030-01-01"))


@query(
    "a07_top_skills",
    cte("histograms")
    + """SELECT name, CAST(sum(count) AS BIGINT) AS count FROM histograms
WHERE dimension = 'skill' AND snapshot_date = (SELECT max(snapshot_date) FROM histograms)
GROUP BY name ORDER BY count DESC, name LIMIT 10""",
)
def a07(spark, sf):
    return trend.top_names(histograms(spark, sf), snapshots(spark, sf), "skill", 10)


@query(
    "f21_top_roles_gated",
    cte("histograms", "snapshots")
    + """, market AS (SELECT sum(enriched_jobs) / CAST(sum(total_open_jobs) AS DOUBLE) AS coverage FROM snapshots
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM snapshots))
SELECT name, CAST(sum(count) AS BIGINT) AS count FROM histograms, market
WHERE dimension = 'role' AND snapshot_date = (SELECT max(snapshot_date) FROM histograms) AND coverage >= 0.5
GROUP BY name ORDER BY count DESC, name LIMIT 50""",
)
def f21(spark, sf):
    return trend.top_names(histograms(spark, sf), snapshots(spark, sf), "role", 50, gated=True)


@query(
    "a08_role_detail",
    cte("companies", "histograms", "snapshots")
    + """SELECT h.company_id, c.name AS company, c.slug, h.count, CAST(s.snapshot_date AS VARCHAR) AS snapshot_date, s.enrichment_coverage
FROM histograms h JOIN snapshots s USING (company_id, snapshot_date) JOIN companies c ON c.company_id = h.company_id
WHERE h.dimension = 'role' AND h.name = 'click' AND s.enrichment_coverage >= 0.5
  AND s.snapshot_date = (SELECT max(snapshot_date) FROM snapshots)""",
)
def a08(spark, sf):
    return plain(
        trend.name_detail(standin(spark, sf, "companies"), snapshots(spark, sf), histograms(spark, sf), "role", "click")
    )


@query(
    "a09_market_total_on_day",
    cte("snapshots") + f"SELECT CAST(sum(total_open_jobs) AS BIGINT) AS total FROM snapshots WHERE snapshot_date = DATE '{_DAY}'",
)
def a09(spark, sf):
    return trend.market_total_on(snapshots(spark, sf), _DAY)


def change_sql(now: str, before: str, prefix: str) -> str:
    return (
        f"{now} - {before} AS {prefix}_absolute, "
        f"CASE WHEN {before} <> 0 THEN CAST(sign({now} - {before}) * ((abs({now} - {before}) * 20000 + {before}) // (2 * {before})) / 100.0 AS DOUBLE) END AS {prefix}_percent"
    )


def flat_changes(df):
    for n in trend.LAGS:
        change = F.col(f"change_{n}d")
        df = df.withColumn(f"change_{n}d_absolute", change["absolute"]).withColumn(f"change_{n}d_percent", change["percent"])
    return df.drop("change_7d", "change_30d")


@query(
    "a10_trends",
    cte("snapshots")
    + f""", days AS (SELECT snapshot_date, CAST(sum(total_open_jobs) AS BIGINT) AS total, CAST(sum(enriched_jobs) AS BIGINT) AS enriched
  FROM snapshots GROUP BY 1), latest AS (SELECT * FROM days ORDER BY snapshot_date DESC LIMIT 1)
SELECT CAST(l.snapshot_date AS VARCHAR) AS snapshot_date, l.total AS total_open_jobs,
  l.enriched / CAST(l.total AS DOUBLE) AS enrichment_coverage, l.enriched / CAST(l.total AS DOUBLE) >= 0.5 AS available,
  {change_sql("l.total", "w.total", "change_7d")}, {change_sql("l.total", "m.total", "change_30d")}
FROM latest l LEFT JOIN days w ON w.snapshot_date = l.snapshot_date - 7 LEFT JOIN days m ON m.snapshot_date = l.snapshot_date - 30""",
)
def a10(spark, sf):
    rows = flat_changes(trend.trends(snapshots(spark, sf)))
    return plain(
        rows.select(
            "snapshot_date", "total_open_jobs", "enrichment_coverage", "available", "change_7d_absolute",
            "change_7d_percent", "change_30d_absolute", "change_30d_percent",
        )
    )


@query(
    "j17_exact_lag_change",
    cte("snapshots")
    + f""", recent AS (SELECT * FROM snapshots WHERE snapshot_date >= DATE '2024-01-30' - 31),
latest AS (SELECT company_id, max(snapshot_date) AS latest_date FROM recent GROUP BY 1)
SELECT l.company_id, CAST(l.latest_date AS VARCHAR) AS latest_date, s.total_open_jobs,
  {change_sql("s.total_open_jobs", "w.total_open_jobs", "change_7d")}, {change_sql("s.total_open_jobs", "m.total_open_jobs", "change_30d")}
FROM latest l JOIN recent s ON s.company_id = l.company_id AND s.snapshot_date = l.latest_date
LEFT JOIN recent w ON w.company_id = l.company_id AND w.snapshot_date = l.latest_date - 7
LEFT JOIN recent m ON m.company_id = l.company_id AND m.snapshot_date = l.latest_date - 30""",
)
def j17(spark, sf):
    return plain(flat_changes(trend.company_trends(snapshots(spark, sf), "2024-01-30")))


@query(
    "j08_latest_snapshot_per_company",
    cte("companies", "snapshots")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY snapshot_date DESC) AS rn FROM snapshots)
SELECT c.company_id, c.name, CAST(s.snapshot_date AS VARCHAR) AS snapshot_date, s.total_open_jobs, s.new_jobs, s.enrichment_coverage
FROM companies c LEFT JOIN ranked s ON s.company_id = c.company_id AND s.rn = 1""",
)
def j08(spark, sf):
    rows = trend.latest_snapshot(standin(spark, sf, "companies"), snapshots(spark, sf))
    return plain(rows.select("company_id", "name", "snapshot_date", "total_open_jobs", "new_jobs", "enrichment_coverage"))


@query(
    "w6_company_history",
    cte("snapshots")
    + """SELECT company_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, total_open_jobs, new_jobs, removed_jobs,
  changed_jobs, enriched_jobs, enrichment_coverage FROM snapshots WHERE snapshot_date >= DATE '2024-01-25' - 14""",
)
def w6(spark, sf):
    return plain(trend.company_history(snapshots(spark, sf), "2024-01-25", 14))


@query(
    "j09_unnest_histogram_maps",
    """WITH keyed AS (SELECT event_id AS company_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_date, props, unnest(json_keys(props)) AS name FROM events)
SELECT company_id, snapshot_date, unnest(['role', 'skill']) AS dimension, name,
  CAST(json_extract_string(props, '$.' || name) AS BIGINT) AS count FROM keyed""",
)
def j09(spark, sf):
    # The maps come in as JSON objects.
    maps = table(spark, sf, "events").selectExpr(
        "event_id AS company_id",
        "CAST(ts AS DATE) AS snapshot_date",
        "from_json(props, 'map<string,bigint>') AS role_counts",
        "from_json(props, 'map<string,bigint>') AS skill_counts",
    )
    return plain(snap.unpack_histograms(maps, {"role_counts": "role", "skill_counts": "skill"}))


@query(
    "o4_top_entries",
    cte("histograms")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id, snapshot_date, dimension ORDER BY count DESC, name) AS rank
  FROM histograms)
SELECT company_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, dimension, rank, name, count FROM ranked WHERE rank <= 3""",
)
def o4(spark, sf):
    return plain(snap.top_entries(histograms(spark, sf), 3))
