"""Lifecycle, canonical view and enrichment queue over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelake.functions import scalar as fn
from hirelake.operators import canonical as canon, eligibility as elig, lifecycle as life, quality, queue as q
from hirelake.operators.stored_view import StoredView
from hirelake.plans.company_queries import TS
from hirelake.plans.registry import query
from hirelake.plans.standins import EVENTS_AS_OF, ORDERS_AS_OF, cte, plain, standin, stored, table
from hirelake.session import scratch
from hirelake.sources.buckets import buckets_for
from hirelake.sources.store import absent, append_counted, last_per_key

# --- one crawl per calendar day of the event table --------------------------
# Source d is day d: its batch is that day's events, its state the day before.

_DAY = "datediff(CAST(ts AS DATE), DATE '2024-01-01')"
_POSTING = {
    "external_job_id": "CAST(user_id AS STRING)",
    "provider": "'lever'",
    "company_id": "CAST(NULL AS STRING)",
    "company": "CAST(NULL AS STRING)",
    "title": "event_type",
    "location": "CASE WHEN value > 20 THEN 'Austin, TX' END",
    "employment_type": "CAST(NULL AS STRING)",
    "workplace_type": "CAST(NULL AS STRING)",
    "posted_at": "CASE WHEN event_type <> 'error' THEN ts END",
    "posted_at_source": "CASE WHEN event_type <> 'error' THEN 'feed' END",
    "description_text": "props",
    "description_html": "CAST(NULL AS STRING)",
    "job_url": "CAST(NULL AS STRING)",
    "apply_url": "CAST(NULL AS STRING)",
    "raw_payload": "props",
    "content_hash": "concat(event_type, CASE WHEN value > 20 THEN '+' ELSE '-' END)",
}


def crawl_inputs(spark, sf):
    events = table(spark, sf, "events")
    posting = [f"{e} AS {c}" for c, e in _POSTING.items()]
    batch = events.selectExpr(f"CAST({_DAY} AS BIGINT) AS source_id", "struct(ts, event_id) AS pos", "user_id", "event_id", *posting)
    before = last_per_key(batch, ["source_id", "external_job_id"], [F.col("pos")])
    state = before.selectExpr(
        "CAST(event_id AS STRING) AS job_id", "source_id + 1 AS source_id", *[c for c in _POSTING],
        "title <> 'purchase' AS active", "CASE WHEN user_id % 7 <> 0 THEN user_id % 5 <> 0 END AS is_us_job",
        "pos.ts AS first_seen_at", "pos.ts AS last_seen_at", "CAST(source_id AS BIGINT) AS last_seen_crawl_id",
        "CASE WHEN title = 'purchase' THEN pos.ts END AS removed_at",
        "CAST(NULL AS TIMESTAMP) AS observed_new_after", "CAST(NULL AS TIMESTAMP) AS observed_new_before",
        "'eligible' AS enrichment_eligibility", "CAST(NULL AS STRING) AS enrichment_eligibility_reason",
        "'ready' AS classification_status", "1 AS classification_attempts",
        "pos.ts AS classification_started_at", "CAST(NULL AS STRING) AS classification_error",
        "pos.ts AS classified_at", "content_hash AS classified_content_hash",
    )
    days = batch.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    crawls = days.selectExpr(
        "source_id", "source_id + 1000 AS crawl_run_id", "date_add(DATE '2024-01-01', CAST(source_id AS INT)) + INTERVAL '9' HOUR AS started_at",
        "CASE WHEN source_id % 7 = 6 THEN 'failed' ELSE 'success' END AS status",
        "CASE WHEN source_id % 7 = 6 THEN 'HTTP 500' END AS error",
    )
    sources = days.selectExpr(
        "source_id", "'active' AS status", "CAST(NULL AS TIMESTAMP) AS last_attempt_at",
        "CAST(NULL AS TIMESTAMP) AS last_crawled_at",
        "CASE WHEN source_id > 0 THEN date_add(DATE '2024-01-01', CAST(source_id AS INT)) - INTERVAL '15' HOUR END AS last_success_at",
        "CAST(NULL AS TIMESTAMP) AS last_failure_at",
        "CASE WHEN source_id % 3 = 0 THEN n * 5 ELSE n END AS last_job_count",
        "CAST(source_id % 4 AS INT) AS consecutive_failures", "'old error' AS last_error",
    )
    return state, batch.drop("user_id", "event_id"), crawls, sources


def crawl_rows(spark, sf, keep=lambda state: state):
    state, batch, crawls, sources = crawl_inputs(spark, sf)
    state = keep(state)
    decisions = life.crawl_decisions(crawls, sources, batch)
    return life.with_outcome(life.diff(state, batch, decisions), EVENTS_AS_OF), decisions, sources


_K = "CASE WHEN value > 20 THEN '+' ELSE '-' END"
_CRAWL_SQL = f"""WITH ev AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, event_id, ts, user_id, event_type, props, value,
    event_type || {_K} AS hash, CASE WHEN event_type <> 'error' THEN ts END AS posted_at,
    row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events),
last AS (SELECT * FROM ev WHERE rn = 1),
srcs AS (SELECT d AS source_id, count(*) AS n, CASE WHEN d % 3 = 0 THEN count(*) * 5 ELSE count(*) END AS prev,
    d % 7 <> 6 AS ok FROM ev GROUP BY d),
dec AS (SELECT *, CASE WHEN prev > 0 AND n = 0 THEN 'zero' WHEN prev >= 20 AND n < prev * 0.25 THEN
    'mass-drop anomaly: previous_job_count=' || prev || ', current_job_count=' || n || ', threshold_ratio=0.25' END AS anomaly FROM srcs),
pairs AS (
  SELECT coalesce(o.d + 1, n.d) AS source_id, CAST(coalesce(o.user_id, n.user_id) AS VARCHAR) AS external_job_id,
    o.event_id AS old_id, o.hash AS old_hash, o.event_type AS old_title, o.ts AS old_ts, o.posted_at AS old_posted,
    o.value AS old_value, o.props AS old_props,
    CASE WHEN o.user_id % 7 <> 0 THEN o.user_id % 5 <> 0 END AS old_us,
    n.event_id AS new_id, n.hash AS new_hash, n.event_type AS new_title, n.posted_at AS new_posted, n.value AS new_value
  FROM last o FULL JOIN last n ON n.d = o.d + 1 AND n.user_id = o.user_id),
flags AS (
  SELECT p.*, d.n, d.prev, d.anomaly, coalesce(d.ok, FALSE) AS ok, p.source_id = 0 AS baseline,
    new_id IS NOT NULL AND coalesce(d.ok, FALSE) AS seen
  FROM pairs p LEFT JOIN dec d USING (source_id)),
rows AS (
  SELECT *, seen AND old_id IS NULL AS is_created, seen AND old_id IS NOT NULL AND old_hash <> new_hash AS is_changed,
    seen AND old_id IS NOT NULL AND old_title = 'purchase' AS is_reactivated,
    coalesce(NOT seen AND old_title <> 'purchase' AND ok AND anomaly IS NULL, FALSE) AS is_removed,
    CASE WHEN old_us IS FALSE THEN 'non_us' WHEN coalesce(new_posted, old_posted) IS NULL THEN 'missing_posted_at'
      WHEN coalesce(new_posted, old_posted) < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY THEN 'older_than_1_day' END AS reason,
    coalesce(CAST(old_id AS VARCHAR), left(sha256(source_id || chr(31) || external_job_id), 32)) AS job_id
  FROM flags WHERE old_id IS NOT NULL OR seen),
queued AS (SELECT *, CASE WHEN reason IS NULL AND is_created AND baseline THEN 'bootstrap'
    WHEN reason IS NULL AND is_created THEN 'new_job' WHEN reason IS NULL AND is_changed THEN 'changed_job' END AS queue_reason FROM rows)
"""


@query(
    "j18_lifecycle_diff",
    _CRAWL_SQL
    + """SELECT source_id, external_job_id, job_id, is_created, is_changed, is_reactivated, is_removed,
  CASE WHEN reason IS NULL THEN 'eligible' ELSE 'not_eligible' END AS eligibility, reason AS eligibility_reason, queue_reason,
  CAST(CASE queue_reason WHEN 'bootstrap' THEN 3 WHEN 'new_job' THEN 1 WHEN 'changed_job' THEN 2 END AS DOUBLE) AS queue_priority
FROM queued""",
)
def j18(spark, sf):
    # The state lies in buckets of the key, so only the crawl is shuffled.
    rows, _, _ = crawl_rows(spark, sf, lambda state: stored(spark, state, tuple(life.KEY)).read())
    return plain(
        rows.select(
            "source_id", "external_job_id", "job_id", "is_created", "is_changed", "is_reactivated", "is_removed",
            "eligibility", "eligibility_reason", "queue_reason", F.col("queue_priority").cast("double"),
        )
    )


_EVENT_ROWS = ", ".join(["job_id", "event_type", "metadata", "crawl_run_id"])


@query(
    "l01_lifecycle_events",
    _CRAWL_SQL
    + """SELECT job_id, 'created' AS event_type, CASE WHEN baseline THEN '{"baseline": true}' ELSE '{"baseline": false}' END AS metadata,
  source_id + 1000 AS crawl_run_id FROM rows WHERE is_created
UNION ALL SELECT job_id, 'changed', '{}', source_id + 1000 FROM rows WHERE is_changed
UNION ALL SELECT job_id, 'reactivated', '{}', source_id + 1000 FROM rows WHERE is_reactivated
UNION ALL SELECT job_id, 'removed', '{}', source_id + 1000 FROM rows WHERE is_removed""",
)
def l01(spark, sf):
    rows, _, _ = crawl_rows(spark, sf)
    return plain(life.lifecycle_events(rows, EVENTS_AS_OF).select("job_id", "event_type", "metadata", "crawl_run_id"))


@query(
    "l02_superseded_versions",
    _CRAWL_SQL
    + """SELECT job_id, old_hash AS content_hash, old_title AS title, CASE WHEN old_value > 20 THEN 'Austin, TX' END AS location,
  old_props AS description_text FROM rows WHERE is_changed""",
)
def l02(spark, sf):
    rows, _, _ = crawl_rows(spark, sf)
    versions = life.superseded_versions(rows, EVENTS_AS_OF)
    return plain(versions.select("job_id", "content_hash", "title", "location", "description_text"))


@query(
    "l03_state_after_crawl",
    _CRAWL_SQL
    + f"""SELECT job_id, source_id, external_job_id, CASE WHEN seen THEN new_title ELSE old_title END AS title,
  CASE WHEN seen THEN new_hash ELSE old_hash END AS content_hash,
  strftime(CASE WHEN seen THEN coalesce(new_posted, old_posted) ELSE old_posted END, '{TS}') AS posted_at,
  CASE WHEN seen THEN TRUE WHEN is_removed THEN FALSE ELSE old_title <> 'purchase' END AS active,
  strftime(CASE WHEN is_removed THEN TIMESTAMP '{EVENTS_AS_OF}' WHEN NOT seen AND old_title = 'purchase' THEN old_ts END, '{TS}') AS removed_at,
  strftime(CASE WHEN seen THEN TIMESTAMP '{EVENTS_AS_OF}' ELSE old_ts END, '{TS}') AS last_seen_at,
  CASE WHEN seen THEN source_id + 1000 ELSE source_id - 1 END AS last_seen_crawl_id,
  CASE WHEN seen AND reason IS NOT NULL THEN 'not_eligible' WHEN is_created OR is_changed THEN 'pending' ELSE 'ready' END AS classification_status,
  CAST(CASE WHEN is_created OR is_changed THEN 0 ELSE 1 END AS BIGINT) AS classification_attempts,
  CASE WHEN NOT is_changed THEN old_hash END AS classified_content_hash,
  strftime(CASE WHEN seen AND new_posted IS NULL AND source_id > 0
    THEN DATE '2024-01-01' + CAST(source_id AS INT) - INTERVAL 15 HOUR END, '{TS}') AS observed_new_after,
  strftime(CASE WHEN seen AND new_posted IS NULL AND source_id > 0
    THEN DATE '2024-01-01' + CAST(source_id AS INT) + INTERVAL 9 HOUR END, '{TS}') AS observed_new_before
FROM rows""",
)
def l03(spark, sf):
    rows, _, _ = crawl_rows(spark, sf)
    return plain(
        life.next_state(rows, EVENTS_AS_OF).select(
            "job_id", "source_id", "external_job_id", "title", "content_hash", "posted_at", "active", "removed_at",
            "last_seen_at", "last_seen_crawl_id", "classification_status", "classification_attempts",
            "classified_content_hash", "observed_new_after", "observed_new_before",
        )
    )


@query(
    "l01_queue_entries",
    _CRAWL_SQL
    + """SELECT job_id, new_hash AS content_hash, queue_reason AS reason,
  CAST(CASE queue_reason WHEN 'bootstrap' THEN 3 WHEN 'new_job' THEN 1 ELSE 2 END AS BIGINT) AS priority,
  left(sha256(job_id || chr(31) || new_hash || chr(31) || 'v3'), 32) AS queue_id
FROM queued WHERE queue_reason IS NOT NULL""",
)
def l01_queue(spark, sf):
    rows, _, _ = crawl_rows(spark, sf)
    none = rows.selectExpr("job_id", "new_content_hash AS content_hash", "'v3' AS schema_version").filter("false")
    entries = life.queue_entries(rows, none, EVENTS_AS_OF)
    return plain(entries.select("job_id", "content_hash", "reason", "priority", "queue_id"))


@query(
    "c12_mass_drop_decisions",
    _CRAWL_SQL
    + """SELECT source_id, n AS job_count, prev AS last_job_count, ok AS succeeded, ok AND anomaly IS NULL AS may_remove, anomaly FROM dec""",
)
def c12(spark, sf):
    _, decisions, _ = crawl_rows(spark, sf)
    return plain(decisions.select("source_id", "job_count", "last_job_count", "succeeded", "may_remove", "anomaly"))


@query(
    "l09_sources_after_crawl",
    _CRAWL_SQL
    + f"""SELECT source_id, CASE WHEN NOT ok AND source_id % 4 + 1 >= 3 THEN 'inactive' ELSE 'active' END AS status,
  strftime(CASE WHEN ok THEN TIMESTAMP '{EVENTS_AS_OF}' WHEN source_id > 0 THEN DATE '2024-01-01' + CAST(source_id AS INT) - INTERVAL 15 HOUR END, '{TS}') AS last_success_at,
  CASE WHEN ok AND anomaly IS NULL THEN n ELSE prev END AS last_job_count,
  CAST(CASE WHEN ok THEN 0 ELSE source_id % 4 + 1 END AS BIGINT) AS consecutive_failures,
  CASE WHEN NOT ok THEN 'HTTP 500' END AS last_error FROM dec""",
)
def l09(spark, sf):
    _, decisions, sources = crawl_rows(spark, sf)
    after = life.next_sources(sources, decisions, EVENTS_AS_OF)
    return plain(
        after.select("source_id", "status", "last_success_at", "last_job_count", "consecutive_failures", "last_error")
    )


_SUMMARY_SQL = (
    _CRAWL_SQL
    + """SELECT count(*) AS source_count, count(*) FILTER (WHERE ok) AS successful_sources,
  count(*) FILTER (WHERE NOT ok) AS failed_sources, count(*) FILTER (WHERE ok AND anomaly IS NOT NULL) AS anomaly_sources,
  CAST(sum(n) FILTER (WHERE ok) AS BIGINT) AS job_count,
  (SELECT count(*) FROM rows WHERE is_created AND NOT baseline) AS jobs_new,
  (SELECT count(*) FROM rows WHERE is_changed) AS jobs_changed,
  (SELECT count(*) FROM rows WHERE is_removed) AS jobs_removed FROM dec"""
)


@query("a15_crawl_summary", _SUMMARY_SQL)
def a15(spark, sf):
    rows, decisions, _ = crawl_rows(spark, sf)
    return plain(life.crawl_summary(life.source_summary(rows, decisions)))


@query("a15_summary_as_written", _SUMMARY_SQL)
def a15_written(spark, sf):
    rows, decisions, _ = crawl_rows(spark, sf)
    return plain(append_counted(life.source_summary(rows, decisions), scratch(spark, "crawls"), life.crawl_figures()))


# --- eligibility and publication --------------------------------------------


@query(
    "f04_enrichment_eligibility",
    cte("jobs")
    + f"""SELECT job_id, CASE WHEN r IS NULL THEN 'eligible' ELSE 'not_eligible' END AS status, r AS reason FROM (
  SELECT job_id, CASE WHEN is_us_job IS FALSE THEN 'non_us' WHEN posted_at IS NULL THEN 'missing_posted_at'
    WHEN posted_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY THEN 'older_than_1_day' END AS r FROM jobs)""",
)
def f04(spark, sf):
    found = elig.eligibility(F.col("posted_at"), F.col("is_us_job"), EVENTS_AS_OF)
    return standin(spark, sf, "jobs").select("job_id", found.alias("e")).select("job_id", "e.status", "e.reason")


def _windows_sql() -> str:
    parts = []
    for days, undated in ((15, True), (7, True), (3, False), (1, False)):
        missing = "" if undated else "WHEN posted_at IS NULL THEN 'missing_posted_at'"
        parts.append(
            f"SELECT job_id, {days} AS days, CASE WHEN is_us_job IS FALSE THEN 'non_us' {missing} "
            f"WHEN posted_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {days} DAY THEN '{elig.window_reason(days)}' END AS reason FROM jobs"
        )
    return (
        cte("jobs")
        + "SELECT CAST(days AS BIGINT) AS days, coalesce(reason, 'eligible') AS outcome, count(*) AS n FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY ALL"
    )


@query("f05_eligibility_windows", _windows_sql())
def f05(spark, sf):
    variants = F.array(
        *[
            F.struct(
                F.lit(days).cast("bigint").alias("days"),
                F.coalesce(
                    elig.eligibility_reason(F.col("posted_at"), F.col("is_us_job"), EVENTS_AS_OF, days, undated),
                    F.lit("eligible"),
                ).alias("outcome"),
            )
            for days, undated in ((15, True), (7, True), (3, False), (1, False))
        ]
    )
    # One scan for all windows.
    return (
        standin(spark, sf, "jobs").select(F.inline(variants)).groupBy("days", "outcome").agg(F.count(F.lit(1)).alias("n"))
    )


_READY = "active AND classification_status = 'ready' AND classified_content_hash = content_hash"


@query("f03_public_jobs", cte("jobs") + f"SELECT job_id FROM jobs WHERE {_READY} AND is_us_job")
def f03(spark, sf):
    return canon.public_jobs(standin(spark, sf, "jobs")).select("job_id")


@query(
    "f01_public_jobs_48h_any_country",
    cte("jobs") + f"SELECT job_id FROM jobs WHERE {_READY} AND posted_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR",
)
def f01(spark, sf):
    return canon.public_jobs(standin(spark, sf, "jobs"), EVENTS_AS_OF, 48, require_us=False).select("job_id")


@query(
    "f02_public_jobs_48h",
    cte("jobs")
    + f"SELECT job_id FROM jobs WHERE {_READY} AND is_us_job AND posted_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR",
)
def f02(spark, sf):
    return canon.public_jobs(standin(spark, sf, "jobs"), EVENTS_AS_OF, 48).select("job_id")


# --- canonical view ---------------------------------------------------------

_T = f"TIMESTAMP '{ORDERS_AS_OF}'"
_CURRENT = """, current AS (SELECT * FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.job_id ORDER BY e.created_at DESC, e.enrichment_id DESC) AS rn
  FROM enrichments e JOIN order_jobs j USING (job_id, content_hash) WHERE e.schema_version = 'v3') WHERE rn = 1)
"""
_CANONICAL_SQL = (
    cte("order_jobs", "enrichments", "job_versions", "order_events")
    + _CURRENT
    + f""", canonical AS (SELECT j.job_id, j.external_job_id, j.source_id, j.company_id, j.company AS company_name, j.title AS original_title,
  j.provider, j.job_url, j.apply_url, j.posted_at, j.posted_at_source, j.first_seen_at, j.last_seen_at, j.removed_at, j.active,
  j.observed_new_after, j.observed_new_before, j.location, j.description_html, j.last_seen_at AS last_verified_at,
  round(greatest(0, epoch({_T} - coalesce(j.posted_at, j.first_seen_at)) / 3600.0), 2) AS freshness_hours,
  CASE WHEN j.posted_at IS NOT NULL THEN coalesce(j.posted_at_source, 'posted_at') ELSE 'first_seen_at' END AS freshness_source,
  CASE WHEN {_T} - coalesce(j.posted_at, j.first_seen_at) < INTERVAL 24 HOUR THEN 'under_24h'
    WHEN {_T} - coalesce(j.posted_at, j.first_seen_at) < INTERVAL 4 DAY THEN '1_3_days'
    WHEN {_T} - coalesce(j.posted_at, j.first_seen_at) < INTERVAL 8 DAY THEN '4_7_days'
    WHEN {_T} - coalesce(j.posted_at, j.first_seen_at) < INTERVAL 31 DAY THEN '8_30_days' ELSE '30_plus_days' END AS job_age_bucket,
  e.standardized_title, e.job_family, e.job_subfamily, e.related_roles, e.role_track, e.seniority, e.leadership_level,
  e.role_keywords, e.responsibility_tags, e.skills, e.required_skills, e.preferred_skills, e.soft_skills,
  e.years_experience_min, e.years_experience_max, e.education_required, e.education_preferred, e.education_level,
  e.education_fields, e.certifications, e.locations, e.preferred_locations, e.city, e.state, e.state_code, e.country,
  e.country_code, e.relocation_available, e.salary_min, e.salary_max, e.salary_currency, e.salary_period, e.visa_sponsorship,
  e.work_authorization_required, e.citizenship_requirement, e.security_clearance_required, e.security_clearance_level,
  coalesce(e.skill_count, 0) AS skill_count, coalesce(e.workplace_type, j.workplace_type) AS workplace_type,
  coalesce(e.employment_type, j.employment_type) AS employment_type, e.confidence AS classification_confidence,
  coalesce(v.n, 0) + 1 AS version_count, c.last_changed_at,
  EXISTS (SELECT 1 FROM job_versions o WHERE o.job_id = j.job_id AND o.title IS DISTINCT FROM j.title) AS title_changed,
  EXISTS (SELECT 1 FROM job_versions o WHERE o.job_id = j.job_id AND o.location IS DISTINCT FROM j.location) AS location_changed,
  CASE WHEN e.enrichment_id IS NOT NULL THEN EXISTS (SELECT 1 FROM enrichments o WHERE o.job_id = j.job_id
    AND o.content_hash <> j.content_hash AND (o.salary_min IS DISTINCT FROM e.salary_min OR o.salary_max IS DISTINCT FROM e.salary_max)) END AS salary_changed,
  CAST(greatest(0, floor(epoch(coalesce(j.removed_at, {_T}) - j.first_seen_at) / 86400)) AS BIGINT) AS days_active,
  j.description_text
FROM order_jobs j LEFT JOIN current e USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM job_versions GROUP BY 1) v USING (job_id)
LEFT JOIN (SELECT job_id, max(occurred_at) FILTER (WHERE event_type = 'changed') AS last_changed_at FROM order_events GROUP BY 1) c USING (job_id))
"""
)


def canonical(spark, sf):
    return canon.canonical_jobs(
        *[standin(spark, sf, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events")], ORDERS_AS_OF
    )


# Columns of the view by how they are compared.
_VIEW_TIMES = (
    "posted_at", "first_seen_at", "last_seen_at", "removed_at", "observed_new_after", "observed_new_before",
    "last_verified_at", "last_changed_at",
)
_VIEW_LISTS = (
    "related_roles", "role_keywords", "responsibility_tags", "skills", "required_skills", "preferred_skills", "soft_skills",
    "education_fields", "certifications", "locations", "preferred_locations",
)
_VIEW_OTHERS = (
    "job_id", "external_job_id", "source_id", "company_id", "provider", "company_name", "original_title",
    "standardized_title", "job_url", "apply_url", "posted_at_source", "active", "freshness_hours", "freshness_source",
    "job_age_bucket", "job_family", "job_subfamily", "role_track", "seniority", "leadership_level", "skill_count",
    "years_experience_min", "years_experience_max", "education_required", "education_preferred", "education_level",
    "location", "city", "state", "state_code", "country", "country_code", "workplace_type", "relocation_available",
    "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period", "visa_sponsorship",
    "work_authorization_required", "citizenship_requirement", "security_clearance_required", "security_clearance_level",
    "classification_confidence", "version_count", "title_changed", "location_changed", "salary_changed", "days_active",
    "description_text", "description_html",
)
_CANONICAL_PLAIN = "SELECT " + ", ".join(
    [
        *(f"strftime({c}, '{TS}') AS {c}" for c in _VIEW_TIMES),
        *(f"array_to_string({c}, '|') AS {c}" for c in _VIEW_LISTS),
        *(f"CAST({c} AS DOUBLE) AS {c}" if c.startswith("years_") else c for c in _VIEW_OTHERS),
    ]
) + " FROM canonical"


@query("p21_canonical_jobs", _CANONICAL_SQL + _CANONICAL_PLAIN)
def p21(spark, sf):
    # Every column of the view, and no other.
    return _plain_view(canonical(spark, sf))


def _plain_view(view):
    assert sorted(view.columns) == sorted((*_VIEW_TIMES, *_VIEW_LISTS, *_VIEW_OTHERS))
    return plain(view.withColumns({c: F.col(c).cast("double") for c in ("years_experience_min", "years_experience_max")}))


def view_days(spark, sf):
    """The tables in three days: every job in an earlier form, then the older jobs as
    they are, then the others; history as it came, some of it before or after its job."""
    jobs, records, versions, events = (standin(spark, sf, n) for n in ("order_jobs", "enrichments", "job_versions", "order_events"))
    earlier = {"content_hash": "CASE content_hash WHEN 'O' THEN 'F' ELSE 'O' END", "title": "'earlier'", "location": "CAST(NULL AS STRING)"}
    first = jobs.withColumns({c: F.expr(e) for c, e in earlier.items()})
    older = F.col("first_seen_at") < F.lit("1998-06-01").cast("timestamp")
    title = F.coalesce("title", F.lit(""))
    for day, (kind, rows) in enumerate([("", first), ("3-MEDIUM", jobs.filter(older)), ("5-LOW", jobs.filter(~older))]):
        years = [(1900, 1996), (1997, 1998), (1999, 2100)][day]
        yield (
            rows,
            records.filter(F.year("created_at").between(*years)),
            versions.filter(title == kind),
            events.filter(F.year("occurred_at").between(*years)),
        )


@query("p21_stored_view", _CANONICAL_SQL + _CANONICAL_PLAIN)
def p21_stored(spark, sf):
    # Kept up over three days; the same rows as the view made from everything.
    jobs, records = standin(spark, sf, "order_jobs"), standin(spark, sf, "enrichments")
    buckets = buckets_for(spark, records.count())  # a count of the files' footers
    kept = StoredView.create(spark, f"kept_{uuid.uuid4().hex}", scratch(spark, "kept"), jobs.schema, records.schema, buckets=buckets)
    for number, day in enumerate(view_days(spark, sf)):
        kept.apply(number, *day)
    return _plain_view(kept.read(ORDERS_AS_OF))


@query(
    "w1_current_enrichment",
    cte("order_jobs", "enrichments")
    + _CURRENT
    + f"SELECT job_id, enrichment_id, strftime(created_at, '{TS}') AS created_at, salary_min FROM current",
)
def w1(spark, sf):
    facts = canon.enrichment_facts(standin(spark, sf, "order_jobs"), standin(spark, sf, "enrichments"))
    current = facts.filter("e.enrichment_id IS NOT NULL").select("job_id", "e.enrichment_id", "e.created_at", "e.salary_min")
    return plain(current)


@query(
    "a19_versions_and_last_change",
    cte("job_versions", "order_events")
    + f"""SELECT coalesce(v.job_id, c.job_id) AS job_id, coalesce(n, 0) AS versions, strftime(last_changed_at, '{TS}') AS last_changed_at
FROM (SELECT job_id, count(*) AS n FROM job_versions GROUP BY 1) v
FULL JOIN (SELECT job_id, max(occurred_at) FILTER (WHERE event_type = 'changed') AS last_changed_at FROM order_events GROUP BY 1) c USING (job_id)""",
)
def a19(spark, sf):
    versions = canon.version_facts(standin(spark, sf, "job_versions")).select("job_id", F.col("_versions").alias("versions"))
    changes = canon.change_facts(standin(spark, sf, "order_events"))
    return plain(versions.join(changes, "job_id", "full_outer").fillna(0, ["versions"]))


@query(
    "c05_age_and_freshness",
    cte("jobs")
    + f"""SELECT job_id, round(greatest(0, epoch(TIMESTAMP '{EVENTS_AS_OF}' - coalesce(posted_at, first_seen_at)) / 3600.0), 2) AS freshness_hours,
  CASE WHEN posted_at IS NOT NULL THEN coalesce(posted_at_source, 'posted_at') ELSE 'first_seen_at' END AS freshness_source,
  CASE WHEN age < INTERVAL 1 DAY THEN 'under_24h' WHEN age < INTERVAL 4 DAY THEN '1_3_days' WHEN age < INTERVAL 8 DAY THEN '4_7_days'
    WHEN age < INTERVAL 31 DAY THEN '8_30_days' ELSE '30_plus_days' END AS job_age_bucket,
  CAST(greatest(0, floor(epoch(coalesce(removed_at, TIMESTAMP '{EVENTS_AS_OF}') - first_seen_at) / 86400)) AS BIGINT) AS days_active
FROM (SELECT *, TIMESTAMP '{EVENTS_AS_OF}' - coalesce(posted_at, first_seen_at) AS age FROM jobs)""",
)
def c05(spark, sf):
    now, seen = fn.instant(EVENTS_AS_OF), F.coalesce("posted_at", "first_seen_at")
    return plain(
        standin(spark, sf, "jobs").select(
            "job_id",
            fn.freshness_hours(seen, now).alias("freshness_hours"),
            fn.freshness_source(F.col("posted_at"), F.col("posted_at_source")).alias("freshness_source"),
            fn.age_bucket(seen, now).alias("job_age_bucket"),
            fn.days_active(F.col("first_seen_at"), F.col("removed_at"), now).alias("days_active"),
        )
    )


@query(
    "j07_jobs_without_enrichment",
    cte("order_jobs", "enrichments")
    + """SELECT job_id FROM order_jobs j WHERE NOT EXISTS (SELECT 1 FROM enrichments e
  WHERE e.job_id = j.job_id AND e.content_hash = j.content_hash AND e.schema_version = 'v3')""",
)
def j07(spark, sf):
    missing = canon.jobs_without_enrichment(standin(spark, sf, "order_jobs"), standin(spark, sf, "enrichments"))
    return missing.select("job_id")


_LISTED = _CANONICAL_SQL + f""", public AS (SELECT * FROM order_jobs WHERE {_READY} AND is_us_job)
"""


@query(
    "o2_job_list",
    _LISTED
    + f"""SELECT c.job_id AS id, company_name AS company, original_title AS title, left(c.description_text, 300) AS description_excerpt,
  strftime(c.posted_at, '{TS}') AS posted_at, version_count
FROM canonical c JOIN public p USING (job_id) WHERE c.posted_at >= TIMESTAMP '1997-01-01'
ORDER BY coalesce(c.posted_at, c.first_seen_at) DESC, c.job_id DESC LIMIT 100 OFFSET 20""",
)
def o2(spark, sf):
    public = canon.public_jobs(standin(spark, sf, "order_jobs"))
    rows = canon.job_list(public, canonical(spark, sf), "1997-01-01").offset(20).limit(100)
    return plain(rows.select("id", "company", "title", "description_excerpt", "posted_at", "version_count"))


@query(
    "j14_public_canonical_jobs",
    _LISTED + "SELECT c.job_id, c.job_age_bucket, c.standardized_title FROM canonical c JOIN public p USING (job_id)",
)
def j14(spark, sf):
    public = canon.public_jobs(standin(spark, sf, "order_jobs"))
    return canon.job_list(public, canonical(spark, sf)).select("job_id", "job_age_bucket", "standardized_title")


@query(
    "f07_posted_since_count",
    cte("order_jobs") + f"SELECT count(*) AS total FROM order_jobs WHERE {_READY} AND is_us_job AND posted_at >= TIMESTAMP '1997-01-01'",
)
def f07(spark, sf):
    return canon.job_count(canon.public_jobs(standin(spark, sf, "order_jobs")), "1997-01-01")


@query(
    "f19_quality_violations",
    cte("queue", "enrichments", "order_jobs", "job_events")
    + """SELECT 'queue_status' AS rule, count(*) FILTER (WHERE status NOT IN ('pending', 'processing', 'completed', 'failed', 'not_eligible')) AS n FROM queue
UNION ALL SELECT 'queue_priority', count(*) FILTER (WHERE priority NOT BETWEEN 1 AND 3) FROM queue
UNION ALL SELECT 'queue_attempts', count(*) FILTER (WHERE attempts < 0) FROM queue
UNION ALL SELECT 'experience_range', count(*) FILTER (WHERE years_experience_min < 0 OR years_experience_min > years_experience_max) FROM enrichments
UNION ALL SELECT 'confidence', count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) FROM enrichments
UNION ALL SELECT 'token_counts', count(*) FILTER (WHERE input_tokens < 0 OR output_tokens < 0 OR total_tokens < 0) FROM enrichments
UNION ALL SELECT 'ready_hash', count(*) FILTER (WHERE classification_status = 'ready' AND classified_content_hash <> content_hash) FROM order_jobs
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type NOT IN ('created', 'changed', 'removed', 'reactivated')) FROM job_events""",
)
def f19(spark, sf):
    out = None
    for name, rules in (
        ("queue", quality.QUEUE_RULES), ("enrichments", quality.ENRICHMENT_RULES), ("order_jobs", quality.JOB_RULES),
        ("job_events", quality.EVENT_RULES),
    ):
        part = quality.violations(standin(spark, sf, name), rules)
        out = part if out is None else out.unionByName(part)
    return out


# --- queue ------------------------------------------------------------------

_DUE = f"""q.status = 'pending' AND q.attempts < 5 AND q.schema_version = 'v3'
  AND (q.next_attempt_at IS NULL OR q.next_attempt_at <= {_T})"""
_WORKABLE = f"j.active AND j.enrichment_eligibility = 'eligible' AND j.posted_at >= {_T} - INTERVAL 1 DAY"
_DUE_SQL = cte("queue", "order_jobs") + f""", due AS (SELECT q.* FROM queue q
  JOIN order_jobs j ON j.job_id = q.job_id AND j.content_hash = q.content_hash WHERE {_DUE} AND {_WORKABLE})
"""


def queue_and_jobs(spark, sf):
    return standin(spark, sf, "queue"), standin(spark, sf, "order_jobs")


@query("f06_due_queue_rows", _DUE_SQL + "SELECT queue_id FROM due")
def f06(spark, sf):
    return q.due(*queue_and_jobs(spark, sf), ORDERS_AS_OF).select("queue_id")


@query("a18_backlog", _DUE_SQL + "SELECT count(*) AS backlog FROM due")
def a18(spark, sf):
    return q.backlog(*queue_and_jobs(spark, sf), ORDERS_AS_OF)


@query(
    "w4_claimed_batch",
    _DUE_SQL
    + """SELECT queue_id, CAST(priority AS BIGINT) AS priority, reason FROM due
WHERE queue_id NOT IN (SELECT queue_id FROM queue WHERE reason = 'changed_job') ORDER BY priority, created_at, queue_id LIMIT 50""",
)
def w4(spark, sf):
    queue, jobs = queue_and_jobs(spark, sf)
    attempted = queue.filter("reason = 'changed_job'").select("queue_id")
    return plain(q.claim(queue, jobs, ORDERS_AS_OF, 50, attempted).select("queue_id", "priority", "reason"))


@query(
    "l13_queue_after_claim",
    _DUE_SQL
    + f""", batch AS (SELECT queue_id FROM due ORDER BY priority, created_at, queue_id LIMIT 200)
SELECT q.queue_id, CASE WHEN b.queue_id IS NOT NULL THEN 'processing' ELSE status END AS status,
  CAST(attempts + CASE WHEN b.queue_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS attempts,
  strftime(CASE WHEN b.queue_id IS NOT NULL THEN {_T} ELSE started_at END, '{TS}') AS started_at,
  CASE WHEN b.queue_id IS NULL THEN last_error END AS last_error FROM queue q LEFT JOIN batch b USING (queue_id)""",
)
def l13(spark, sf):
    queue, jobs = queue_and_jobs(spark, sf)
    after = q.mark_claimed(queue, q.claim(queue, jobs, ORDERS_AS_OF, 200), ORDERS_AS_OF)
    return plain(after.select("queue_id", "status", "attempts", "started_at", "last_error"))


_OUT = f"(posted_at IS NULL OR posted_at < {_T} - INTERVAL 1 DAY)"
_EXPIRY = "CASE WHEN posted_at IS NULL THEN 'missing_posted_at' ELSE 'older_than_1_day' END"


@query(
    "l11_jobs_expired",
    cte("order_jobs")
    + f"""SELECT job_id, CASE WHEN hit THEN 'not_eligible' ELSE enrichment_eligibility END AS enrichment_eligibility,
  CASE WHEN hit THEN {_EXPIRY} ELSE enrichment_eligibility_reason END AS enrichment_eligibility_reason,
  CASE WHEN hit AND classification_status IN ('pending', 'processing') THEN 'not_eligible' ELSE classification_status END AS classification_status,
  strftime(CASE WHEN NOT hit THEN classification_started_at END, '{TS}') AS classification_started_at
FROM (SELECT *, {_OUT} AND (enrichment_eligibility = 'eligible' OR classification_status IN ('pending', 'processing')) AS hit FROM order_jobs)""",
)
def l11_jobs(spark, sf):
    after = q.expire_jobs(standin(spark, sf, "order_jobs"), ORDERS_AS_OF)
    return plain(
        after.select(
            "job_id", "enrichment_eligibility", "enrichment_eligibility_reason", "classification_status",
            "classification_started_at",
        )
    )


@query(
    "l11_queue_expired",
    cte("queue", "order_jobs")
    + f"""SELECT queue_id, CASE WHEN hit THEN 'not_eligible' ELSE status END AS status,
  CASE WHEN hit THEN {_EXPIRY} ELSE last_error END AS last_error,
  strftime(CASE WHEN hit THEN {_T} ELSE completed_at END, '{TS}') AS completed_at,
  strftime(CASE WHEN NOT hit THEN next_attempt_at END, '{TS}') AS next_attempt_at
FROM (SELECT q.*, j.posted_at, j.job_id IS NOT NULL AND q.status IN ('pending', 'processing') AND {_OUT} AS hit
  FROM queue q LEFT JOIN order_jobs j USING (job_id))""",
)
def l11_queue(spark, sf):
    after = q.expire_queue(*queue_and_jobs(spark, sf), ORDERS_AS_OF)
    return plain(after.select("queue_id", "status", "last_error", "completed_at", "next_attempt_at"))


_WANTED = f"""j.active AND j.content_hash IS NOT NULL AND j.enrichment_eligibility = 'eligible'
  AND j.posted_at >= {_T} - INTERVAL 1 DAY AND j.is_us_job IS DISTINCT FROM FALSE
  AND NOT EXISTS (SELECT 1 FROM enrichments e WHERE e.job_id = j.job_id AND e.content_hash = j.content_hash AND e.schema_version = 'v3')"""


@query(
    "l10_bootstrap_queue",
    cte("queue", "order_jobs", "enrichments")
    + f""", wanted AS (SELECT job_id, content_hash FROM order_jobs j WHERE {_WANTED})
SELECT q.queue_id, CASE WHEN hit THEN 'pending' ELSE status END AS status,
  CAST(CASE WHEN hit THEN 3 ELSE priority END AS BIGINT) AS priority, CASE WHEN hit THEN 'bootstrap' ELSE reason END AS reason,
  CAST(CASE WHEN hit THEN 0 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN NOT hit THEN last_error END AS last_error
FROM (SELECT q.*, w.job_id IS NOT NULL AND q.status IN ('completed', 'failed') AND q.schema_version = 'v3' AS hit
  FROM queue q LEFT JOIN wanted w USING (job_id, content_hash)) q
UNION ALL SELECT left(sha256(w.job_id || chr(31) || w.content_hash || chr(31) || 'v3'), 32), 'pending', 3, 'bootstrap', 0, NULL
FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.job_id = w.job_id AND q.content_hash = w.content_hash AND q.schema_version = 'v3')""",
)
def l10(spark, sf):
    queue, jobs = queue_and_jobs(spark, sf)
    after = q.bootstrap(queue, jobs, standin(spark, sf, "enrichments"), ORDERS_AS_OF)
    return plain(after.select("queue_id", "status", "priority", "reason", "attempts", "last_error"))


def _requeue_sql(which: str) -> str:
    return (
        cte("queue", "order_jobs")
        + f"""SELECT q.queue_id, CASE WHEN hit THEN 'pending' ELSE status END AS status,
  CAST(CASE WHEN hit THEN 0 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN NOT hit THEN retryable END AS retryable,
  strftime(CASE WHEN hit THEN {_T} ELSE next_attempt_at END, '{TS}') AS next_attempt_at
FROM (SELECT q.*, coalesce(q.status = 'failed' AND {which} AND {_WORKABLE}, FALSE) AS hit FROM queue q
  LEFT JOIN order_jobs j ON j.job_id = q.job_id AND j.content_hash = q.content_hash) q"""
    )


@query("l18_requeue_retryable", _requeue_sql("q.retryable IS TRUE"))
def l18(spark, sf):
    after = q.requeue_failed(*queue_and_jobs(spark, sf), ORDERS_AS_OF)
    return plain(after.select("queue_id", "status", "attempts", "retryable", "next_attempt_at"))


@query("l18_requeue_all_failed", _requeue_sql("TRUE"))
def l18_all(spark, sf):
    after = q.requeue_failed(*queue_and_jobs(spark, sf), ORDERS_AS_OF, include_permanent=True)
    return plain(after.select("queue_id", "status", "attempts", "retryable", "next_attempt_at"))


@query(
    "l26_resync_status",
    cte("queue", "order_jobs")
    + f"""SELECT q.queue_id, CASE WHEN hit THEN 'not_eligible' ELSE status END AS status,
  CASE WHEN NOT hit THEN last_error END AS last_error, strftime(CASE WHEN hit THEN {_T} ELSE completed_at END, '{TS}') AS completed_at,
  CASE WHEN j_blocked THEN 'not_eligible' ELSE classification_status END AS classification_status
FROM (SELECT q.*, j.classification_status, j.enrichment_eligibility = 'not_eligible' AS j_blocked,
    j.enrichment_eligibility = 'not_eligible' AND j.content_hash = q.content_hash AND q.status <> 'not_eligible' AS hit
  FROM queue q JOIN order_jobs j USING (job_id)) q""",
)
def l26(spark, sf):
    queue, jobs = queue_and_jobs(spark, sf)
    after = q.resync_queue(queue, jobs, ORDERS_AS_OF).join(
        q.resync_jobs(jobs).select("job_id", "classification_status"), "job_id"
    )
    return plain(after.select("queue_id", "status", "last_error", "completed_at", "classification_status"))


@query(
    "j12_eligibility_under_7_days",
    cte("order_jobs")
    + f"""SELECT job_id, CASE WHEN r IS NULL THEN 'eligible' ELSE 'not_eligible' END AS enrichment_eligibility, r AS enrichment_eligibility_reason
FROM (SELECT job_id, CASE WHEN is_us_job IS FALSE THEN 'non_us' WHEN posted_at < {_T} - INTERVAL 7 DAY THEN 'older_than_7_days' END AS r FROM order_jobs)""",
)
def j12(spark, sf):
    after = q.set_eligibility(standin(spark, sf, "order_jobs"), ORDERS_AS_OF, 7, undated_eligible=True)
    return after.select("job_id", "enrichment_eligibility", "enrichment_eligibility_reason")


@query(
    "s15_insert_or_ignore",
    cte("queue", "order_jobs")
    + """SELECT job_id, content_hash FROM order_jobs j WHERE NOT EXISTS (SELECT 1 FROM queue q
  WHERE q.job_id = j.job_id AND q.content_hash = j.content_hash AND q.schema_version = 'v3')""",
)
def s15(spark, sf):
    queue, jobs = queue_and_jobs(spark, sf)
    fresh = jobs.select("job_id", "content_hash", F.lit("v3").alias("schema_version"))
    return absent(fresh, queue, ["job_id", "content_hash", "schema_version"]).select("job_id", "content_hash")


# --- outcomes ---------------------------------------------------------------

_DECIDED_SQL = (
    cte("queue", "order_jobs")
    + f""", scoped AS (SELECT *, CASE
    WHEN raw_payload LIKE '%"US"%' THEN 'ashby_country_us' WHEN raw_payload LIKE '%"GE"%' THEN 'structured_country_non_us'
    WHEN location = 'Toronto, Canada' THEN 'primary_location_non_us' WHEN location IS NOT NULL THEN 'primary_location_us'
    ELSE 'no_clear_us_evidence' END AS scope FROM order_jobs),
items AS (SELECT q.*, j.content_hash AS job_hash, j.active, j.posted_at, j.scope, j.enrichment_eligibility,
    CASE WHEN j.posted_at IS NULL THEN 'missing_posted_at' WHEN j.posted_at < {_T} - INTERVAL 1 DAY THEN 'older_than_1_day' END AS runtime
  FROM queue q LEFT JOIN scoped j USING (job_id)),
decided AS (SELECT *, CASE WHEN job_hash IS DISTINCT FROM content_hash THEN 'stale'
    WHEN NOT active OR enrichment_eligibility <> 'eligible' OR runtime IS NOT NULL THEN 'not_eligible'
    WHEN scope LIKE '%non_us' THEN 'skipped_non_us' WHEN scope = 'no_clear_us_evidence' THEN 'deferred_scope' ELSE 'apply' END AS first
  FROM items),
reasons AS (SELECT *, CASE WHEN first = 'stale' THEN 'stale_content_hash' WHEN first = 'not_eligible' AND NOT active THEN 'inactive'
    WHEN first = 'not_eligible' THEN coalesce(runtime, 'not_eligible') ELSE scope END AS outcome_reason FROM decided)
"""
)


@query("l14_queue_decisions", _DECIDED_SQL + "SELECT queue_id, first AS outcome, outcome_reason FROM reasons")
def l14(spark, sf):
    return q.decide(*queue_and_jobs(spark, sf), ORDERS_AS_OF).select("queue_id", "outcome", "outcome_reason")


# Stand-in for extraction results: by price, valid, failed for good, or failed for now.
_RESULTS = {
    # Some rows have no result yet.
    "queue_id": "CASE WHEN o_totalprice > 20000 THEN CAST(o_orderkey AS STRING) END",
    "is_valid": "o_totalprice < 300000",
    "error": "CASE WHEN o_totalprice >= 300000 THEN 'no answer' END",
    "error_class": "CASE WHEN o_totalprice >= 300000 THEN 'Timeout' END",
    "retryable": "CASE WHEN o_totalprice >= 300000 THEN o_totalprice < 400000 END",
    "retry_after_seconds": "CASE WHEN o_totalprice >= 350000 THEN 100.0 END",
}
_OUTCOME_SQL = (
    _DECIDED_SQL
    + ", results AS (SELECT "
    + ", ".join(f"{e} AS r_{c}" for c, e in _RESULTS.items())
    + """ FROM orders),
final AS (SELECT d.*, r.*, CASE WHEN first = 'apply' AND r_is_valid THEN 'completed' WHEN first = 'apply' AND NOT r_is_valid THEN 'failed' ELSE first END AS outcome
  FROM reasons d LEFT JOIN results r ON r_queue_id = queue_id),
ends AS (SELECT *, attempts >= 5 OR (outcome = 'failed' AND NOT coalesce(r_retryable, TRUE)) AS terminal,
  outcome IN ('failed', 'deferred_scope') AS retried FROM final)
"""
)


def final_outcomes(spark, sf):
    results = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _RESULTS.items()])
    return q.attach_results(q.decide(*queue_and_jobs(spark, sf), ORDERS_AS_OF), results)


@query(
    "l17_queue_outcomes",
    _OUTCOME_SQL
    + f"""SELECT queue_id, CASE WHEN outcome IN ('stale', 'completed') THEN 'completed' WHEN outcome IN ('not_eligible', 'skipped_non_us') THEN 'not_eligible'
    WHEN retried AND terminal THEN 'failed' WHEN retried THEN 'pending' ELSE status END AS status,
  CASE WHEN outcome = 'failed' THEN r_error WHEN outcome IN ('stale', 'not_eligible', 'deferred_scope') THEN outcome_reason
    WHEN outcome = 'apply' THEN last_error END AS last_error,
  CASE WHEN outcome = 'failed' THEN r_error_class WHEN outcome = 'deferred_scope' THEN 'unknown_scope' WHEN outcome = 'apply' THEN error_class END AS error_class,
  strftime(CASE WHEN outcome = 'apply' THEN next_attempt_at WHEN outcome = 'failed' AND NOT terminal
      THEN {_T} + to_seconds(least(3600, greatest(30 * pow(2, greatest(attempts - 1, 0)), coalesce(r_retry_after_seconds, 0))))
    WHEN retried AND NOT terminal THEN {_T} + INTERVAL 15 MINUTE END, '{TS}') AS next_attempt_at,
  strftime(CASE WHEN outcome = 'apply' THEN completed_at WHEN NOT retried OR terminal THEN {_T} END, '{TS}') AS completed_at
FROM ends""",
)
def l17(spark, sf):
    after = q.apply_queue_outcomes(standin(spark, sf, "queue"), final_outcomes(spark, sf), ORDERS_AS_OF)
    return plain(after.select("queue_id", "status", "last_error", "error_class", "next_attempt_at", "completed_at"))


@query(
    "l15_jobs_after_outcomes",
    _OUTCOME_SQL
    + """SELECT j.job_id, CASE WHEN e.outcome IN ('completed', 'apply', 'failed') THEN TRUE WHEN e.outcome = 'skipped_non_us' THEN FALSE
    WHEN e.outcome = 'deferred_scope' THEN NULL ELSE j.is_us_job END AS is_us_job,
  CASE WHEN e.outcome IS NULL OR e.outcome IN ('stale', 'not_eligible') THEN j.us_location_reason ELSE e.outcome_reason END AS us_location_reason,
  CASE WHEN e.outcome = 'completed' THEN 'ready' WHEN e.outcome IN ('not_eligible', 'skipped_non_us') THEN 'not_eligible'
    WHEN e.outcome = 'apply' THEN 'processing' WHEN e.retried AND e.terminal THEN 'failed' WHEN e.retried THEN 'pending'
    ELSE j.classification_status END AS classification_status,
  CASE WHEN e.outcome = 'skipped_non_us' THEN 'non_us' WHEN e.outcome = 'not_eligible' THEN e.outcome_reason
    ELSE j.enrichment_eligibility_reason END AS enrichment_eligibility_reason,
  CAST(j.classification_attempts + CASE WHEN e.outcome = 'failed' THEN 1 ELSE 0 END AS BIGINT) AS classification_attempts,
  CASE WHEN e.outcome = 'completed' THEN j.content_hash ELSE j.classified_content_hash END AS classified_content_hash
FROM order_jobs j LEFT JOIN ends e ON e.job_id = j.job_id AND e.content_hash = j.content_hash""",
)
def l15(spark, sf):
    after = q.apply_job_outcomes(standin(spark, sf, "order_jobs"), final_outcomes(spark, sf), ORDERS_AS_OF)
    return plain(
        after.select(
            "job_id", "is_us_job", "us_location_reason", "classification_status", "enrichment_eligibility_reason",
            "classification_attempts", "classified_content_hash",
        )
    )


@query(
    "l13_run_batch",
    cte("queue", "order_jobs")
    + _DECIDED_SQL[len(cte("queue", "order_jobs")):]
    + f""", ready AS (SELECT q.*, row_number() OVER (ORDER BY priority, created_at, queue_id) AS turn FROM reasons q
  WHERE {_DUE} AND queue_id IN (SELECT q2.queue_id FROM queue q2 JOIN order_jobs j ON j.job_id = q2.job_id AND j.content_hash = q2.content_hash WHERE {_WORKABLE})),
-- With fewer rows to apply than the budget, everything due is processed.
cut AS (SELECT max(turn) AS last, count(*) AS used FROM (SELECT turn FROM ready WHERE first = 'apply' ORDER BY turn LIMIT 100))
SELECT queue_id, first AS outcome FROM ready, cut WHERE used < 100 OR turn <= last""",
)
def l13_run(spark, sf):
    return q.run_batch(*queue_and_jobs(spark, sf), ORDERS_AS_OF, 100).select("queue_id", "outcome")
