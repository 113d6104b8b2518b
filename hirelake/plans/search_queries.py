"""Job search, run observability and event streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelake.functions import scalar as fn
from hirelake.operators import canonical as canon, facet_bitmaps, runs as run, search, search_index
from hirelake.plans.company_queries import TS
from hirelake.plans.registry import query
from hirelake.plans.standins import EVENTS_AS_OF, ORDERS_AS_OF, SCHEMAS, cte, plain, snapshots, standin, table
from hirelake.operators.lifecycle import JOB_SCHEMA, SOURCE_SCHEMA
from hirelake.session import configure, cut_lineage, scratch
from hirelake.sources.buckets import buckets_for
from hirelake.sources.store import append_counted
from hirelake.streaming import crawl_stream

_T = f"TIMESTAMP '{ORDERS_AS_OF}'"

# --- search rows ------------------------------------------------------------

# Job rows as the list endpoint returns them, from orders.
_ROWS = {
    "id": "o_orderkey",
    "job_title": "CASE WHEN o_orderstatus <> 'P' THEN 'Engineer ' || o_orderpriority END",
    "company_name": "'Customer%20' || CAST(o_custkey AS STRING)",
    "location": "CASE o_orderstatus WHEN 'O' THEN 'Austin, TX' WHEN 'F' THEN 'Boston, MA' END",
    "description": "'Order of ' || o_orderpriority",
    "job_type": "CASE WHEN o_totalprice > 250000 THEN 'full_time' ELSE '' END",
    "workplace_type": "CASE WHEN o_totalprice > 100000 THEN 'remote' END",
    "min_salary": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS STRING) WHEN o_orderstatus = 'F' THEN 'n/a' END",
    "job_family": "CASE WHEN o_totalprice < 200000 THEN 'data' WHEN o_totalprice < 300000 THEN 'platform' END",
    "job_subfamily": "CASE WHEN o_totalprice < 50000 THEN 'analytics' END",
    "seniority": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'senior' ELSE 'mid' END",
    "years_experience_min": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 9 END",
    "posted_at": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END",
    "first_seen_at": "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL '1' DAY END",
    "provider": "CASE WHEN o_orderstatus = 'P' THEN 'lever' ELSE 'ashby' END",
}
_BASE_SQL = "WITH raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _ROWS.items()) + ", o_orderpriority, o_orderstatus FROM orders)"
_CLIENT_SQL = (
    _BASE_SQL
    + """, jobs AS (SELECT id, coalesce(job_title, 'Untitled role') AS title, replace(company_name, '%20', ' ') AS company, coalesce(location, '') AS location,
  description, job_type AS employment_type, coalesce(workplace_type, '') AS workplace_type, coalesce(job_family, '') AS job_family, coalesce(job_subfamily, '') AS job_subfamily,
  seniority, provider, try_cast(min_salary AS DOUBLE) AS salary_min, CAST(years_experience_min AS DOUBLE) AS years_experience_min,
  coalesce(posted_at, first_seen_at) AS created_at, CASE WHEN posted_at IS NOT NULL THEN 'posted' WHEN first_seen_at IS NOT NULL THEN 'observed' END AS date_source,
  ['SQL', 'sql', 'Skill ' || o_orderpriority] AS skills, CASE WHEN o_orderstatus = 'F' THEN ['Data Engineer'] ELSE [] END AS related_roles,
  list_filter(list_distinct([coalesce(location, ''), CASE WHEN o_orderpriority = '1-URGENT' THEN 'Remote' ELSE 'Austin, ' || CASE WHEN o_orderstatus = 'O' THEN 'TX' ELSE 'Texas' END || ', US' END]), lambda x: x <> '') AS places
FROM raw)
"""
)


def list_rows(spark, sf):
    place = F.struct(
        F.lit("Austin").alias("city"),
        F.lit("Texas").alias("state"),
        F.when(F.col("o_orderstatus") == "O", "TX").otherwise("").alias("state_code"),
        F.lit("US").alias("country_code"),
        (F.col("o_orderpriority") == "1-URGENT").alias("remote"),
    )
    rows = table(spark, sf, "orders").selectExpr("*", *[f"{e} AS {c}" for c, e in _ROWS.items()])
    return rows.select(
        *_ROWS,
        F.array(F.lit("SQL"), F.lit("sql"), F.concat(F.lit("Skill "), "o_orderpriority")).alias("skills"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Data Engineer"))).alias("related_roles"),
        F.array(place).alias("ai_locations"),
    )


def client(spark, sf):
    return canon.client_jobs(list_rows(spark, sf))


_CLIENT_COLUMNS = (
    "id", "title", "company", "location", "description", "employment_type", "workplace_type", "job_family",
    "job_subfamily", "seniority", "provider", "salary_min", "years_experience_min", "created_at", "date_source",
    "skills", "related_roles",
)


@query(
    "p22_client_jobs",
    _CLIENT_SQL
    + f"""SELECT id, title, company, location, description, employment_type, workplace_type, job_family, job_subfamily, seniority, provider, salary_min,
  years_experience_min, strftime(created_at, '{TS}') AS created_at, date_source, array_to_string(skills, '|') AS skills, array_to_string(related_roles, '|') AS related_roles FROM jobs""",
)
def p22(spark, sf):
    return plain(client(spark, sf).select(*_CLIENT_COLUMNS))


@query(
    "p23_job_details",
    _CLIENT_SQL
    + f"""SELECT id, title, replace(company, ' ', '%20') AS company, location, upper(description) AS description, employment_type, workplace_type, job_family,
  job_subfamily, seniority, provider, salary_min, years_experience_min, strftime(created_at, '{TS}') AS created_at, date_source,
  array_to_string(skills, '|') AS skills, array_to_string(related_roles, '|') AS related_roles FROM jobs""",
)
def p23(spark, sf):
    rows = list_rows(spark, sf).withColumn("description_text", F.upper("description"))
    return plain(canon.client_jobs(rows, detail=True).select(*_CLIENT_COLUMNS))


@query("p24_location_labels", _CLIENT_SQL + "SELECT id, array_to_string(list_sort(places), '|') AS places FROM jobs")
def p24(spark, sf):
    labels = F.array_sort(canon.location_labels(F.col("location"), F.col("ai_locations")))
    return plain(client(spark, sf).select("id", labels.alias("places")))


@query(
    "p20_job_list_projection",
    "SELECT doc_id, source AS title, left(text, 300) AS description_excerpt FROM documents",
)
def p20(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS job_id", "lang AS company_name", "source AS original_title", "text AS description_text",
        "CAST(NULL AS TIMESTAMP) AS posted_at", "CAST(NULL AS TIMESTAMP) AS first_seen_at",
    )
    listed = canon.job_list(rows, rows)
    return listed.select(F.col("id").alias("doc_id"), "title", "description_excerpt")


@query(
    "p18_repaired_arrays",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'k' WHEN 'view' THEN 'a|b' ELSE '' END AS repaired, CASE event_type WHEN 'view' THEN 'a|b' ELSE '' END AS strict FROM events""",
)
def p18(spark, sf):
    stored = (
        "CASE event_type WHEN 'click' THEN props WHEN 'view' THEN '[\"a\", \"b\"]' WHEN 'error' THEN '\"text\"' "
        "WHEN 'signup' THEN 'null' END"
    )
    rows = table(spark, sf, "events").select("event_id", F.expr(stored).alias("j"))
    return plain(
        rows.select(
            "event_id", canon.repair_array(F.col("j")).alias("repaired"), canon.array_or_empty(F.col("j")).alias("strict")
        )
    )


@query(
    "f08_recent_jobs",
    cte("jobs") + f"SELECT job_id FROM jobs WHERE posted_at BETWEEN TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR AND TIMESTAMP '{EVENTS_AS_OF}'",
)
def f08(spark, sf):
    return search.recent_jobs(standin(spark, sf, "jobs"), EVENTS_AS_OF).select("job_id")


_TEXTS = "title, company, description, job_family, job_subfamily"


@query(
    "f09_text_search",
    _CLIENT_SQL
    + "SELECT id FROM jobs WHERE contains(lower(concat_ws(chr(1), "
    + _TEXTS
    + ", array_to_string(skills, chr(1)), array_to_string(related_roles, chr(1)))), 'analytic') OR contains(lower(array_to_string(related_roles, chr(1))), 'analytic')",
)
def f09(spark, sf):
    return search.search(client(spark, sf), ORDERS_AS_OF, query=" AnalyTic ").select("id")


@query(
    "f10_place_search",
    _CLIENT_SQL + "SELECT id FROM jobs WHERE len(list_filter(places, lambda x: contains(lower(x), 'tx'))) > 0",
)
def f10(spark, sf):
    return search.search(client(spark, sf), ORDERS_AS_OF, place="TX").select("id")


def indexed(spark, sf):
    """An index of the jobs: most are stored on one day, some of them with other texts,
    beside jobs that will go; the rest comes, and those change, the day after."""
    rows = client(spark, sf).select("id", "title", "company", "description", "job_family", "job_subfamily", "skills", "related_roles", "location", "ai_locations")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    buckets = buckets_for(spark, table(spark, sf, "orders").count())  # a count of the files' footers
    index = search_index.SearchIndex(spark, f"index_{uuid.uuid4().hex}", scratch(spark, "index"), schema, rows.schema["id"].dataType.simpleString(), buckets=buckets).create()
    late, stale = F.expr("pmod(hash(id), 3) = 0"), F.expr("pmod(hash(id), 5) = 0")
    known = rows.withColumn("title", F.when(stale, "analytics of an earlier day").otherwise(F.col("title")))
    going = known.where("pmod(hash(id), 7) = 0").withColumn("id", (-F.col("id") - 1).cast(rows.schema["id"].dataType))
    index.update(known.where(~late).unionByName(going), cut=cut_lineage)
    index.update(rows.where(late | stale), going.select("id"), cut=cut_lineage)
    return index


@query(
    "f09_indexed_text_search",
    _CLIENT_SQL
    + "SELECT id FROM jobs WHERE contains(lower(concat_ws(chr(1), "
    + _TEXTS
    + ", array_to_string(skills, chr(1)), array_to_string(related_roles, chr(1)))), 'analytic') OR contains(lower(array_to_string(related_roles, chr(1))), 'analytic')",
)
def f09_indexed(spark, sf):
    return indexed(spark, sf).search(" AnalyTic ").select("id")


@query(
    "f10_indexed_place_search",
    _CLIENT_SQL + "SELECT id FROM jobs WHERE len(list_filter(places, lambda x: contains(lower(x), 'tx'))) > 0",
)
def f10_indexed(spark, sf):
    return indexed(spark, sf).search(place="TX").select("id")


_AGE = f"date_source = 'posted' AND greatest(0, epoch({_T} - created_at) / 3600.0)"


@query(
    "f11_faceted_search",
    _CLIENT_SQL
    + f"""SELECT id FROM jobs WHERE {_AGE} <= 48 AND (list_contains(places, 'Remote') OR list_contains(places, 'Austin, TX'))
  AND workplace_type = 'remote' AND (job_family = 'platform' OR job_subfamily = 'analytics') AND (seniority = 'senior' OR years_experience_min BETWEEN 3 AND 5)
  AND len(list_filter(skills, lambda x: lower(x) = 'sql')) > 0 AND provider IN ('ashby', 'gem')""",
)
def f11(spark, sf):
    filters = {
        "datePosted": ["48"],
        "location": ["Remote", "Austin, TX"],
        "workplace": ["remote"],
        "role": ["family:platform", "subfamily:analytics"],
        "experience": ["seniority:senior", "years:mid"],
        "employment": [],
        "skill": ["sql"],
        "source": ["ashby", "gem"],
    }
    return search.search(client(spark, sf), ORDERS_AS_OF, filters=filters).select("id")


@query(
    "f12_experience_buckets",
    _CLIENT_SQL
    + """SELECT id, coalesce(years_experience_min <= 2, FALSE) AS entry, coalesce(years_experience_min BETWEEN 3 AND 5, FALSE) AS mid,
  coalesce(years_experience_min >= 6, FALSE) AS senior, seniority = 'senior' AS by_name FROM jobs""",
)
def f12(spark, sf):
    buckets = {"entry": "years:entry", "mid": "years:mid", "senior": "years:senior", "by_name": "seniority:senior"}
    return client(spark, sf).select("id", *[search.experience_matches(v).alias(n) for n, v in buckets.items()])


@query(
    "f13_saved_and_hidden",
    _CLIENT_SQL
    + "SELECT id FROM jobs WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def f13(spark, sf):
    hidden = table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("id"))
    saved = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return search.search(client(spark, sf), ORDERS_AS_OF, hidden=hidden, saved=saved).select("id")


@query(
    "a20_facets",
    _CLIENT_SQL
    + f""", options AS (
  SELECT 'datePosted' AS "group", '24' AS value, '24' AS label, ({_AGE} <= 24)::INT AS hit FROM jobs
  UNION ALL SELECT 'datePosted', '48', '48', ({_AGE} <= 48)::INT FROM jobs
  UNION ALL SELECT 'location', p, p, 1 FROM (SELECT unnest(places) AS p FROM jobs)
  UNION ALL SELECT 'role', 'family:' || job_family, job_family, 1 FROM jobs WHERE job_family <> ''
  UNION ALL SELECT 'role', 'subfamily:' || job_subfamily, job_subfamily, 1 FROM jobs WHERE job_subfamily <> ''
  UNION ALL SELECT 'experience', 'seniority:' || seniority, seniority, 1 FROM jobs
  UNION ALL SELECT 'experience', 'years:entry', 'years:entry', coalesce(years_experience_min <= 2, FALSE)::INT FROM jobs
  UNION ALL SELECT 'experience', 'years:mid', 'years:mid', coalesce(years_experience_min BETWEEN 3 AND 5, FALSE)::INT FROM jobs
  UNION ALL SELECT 'experience', 'years:senior', 'years:senior', coalesce(years_experience_min >= 6, FALSE)::INT FROM jobs
  UNION ALL SELECT 'skill', k, l, 1 FROM (SELECT id, lower(s) AS k, min(s) AS l FROM (SELECT id, unnest(skills) AS s FROM jobs) GROUP BY id, lower(s))
  UNION ALL SELECT 'workplace', workplace_type, workplace_type, 1 FROM jobs WHERE workplace_type <> ''
  UNION ALL SELECT 'employment', employment_type, employment_type, 1 FROM jobs WHERE employment_type <> ''
  UNION ALL SELECT 'company', company, company, 1 FROM jobs UNION ALL SELECT 'source', provider, provider, 1 FROM jobs)
SELECT "group", value, min(label) AS label, CAST(sum(hit) AS BIGINT) AS count FROM options GROUP BY 1, 2""",
)
def a20(spark, sf):
    return search.facets(client(spark, sf), ORDERS_AS_OF)


_FILTERED = "workplace_type = 'remote' AND provider IN ('ashby', 'gem')"


def _facet_rows(where):
    parts = [
        f"SELECT 'datePosted' AS \"group\", '24' AS value FROM jobs WHERE {where} AND {_AGE} <= 24",
        f"SELECT 'datePosted', '48' FROM jobs WHERE {where} AND {_AGE} <= 48",
        f"SELECT 'location', p FROM (SELECT unnest(places) AS p FROM jobs WHERE {where})",
        f"SELECT 'role', 'family:' || job_family FROM jobs WHERE {where} AND job_family <> ''",
        f"SELECT 'role', 'subfamily:' || job_subfamily FROM jobs WHERE {where} AND job_subfamily <> ''",
        f"SELECT 'experience', 'seniority:' || seniority FROM jobs WHERE {where} AND seniority <> ''",
        f"SELECT 'experience', 'years:entry' FROM jobs WHERE {where} AND years_experience_min <= 2",
        f"SELECT 'experience', 'years:mid' FROM jobs WHERE {where} AND years_experience_min BETWEEN 3 AND 5",
        f"SELECT 'experience', 'years:senior' FROM jobs WHERE {where} AND years_experience_min >= 6",
        f"SELECT 'skill', k FROM (SELECT DISTINCT id, lower(s) AS k FROM (SELECT id, unnest(skills) AS s FROM jobs WHERE {where}))",
        f"SELECT 'workplace', workplace_type FROM jobs WHERE {where} AND workplace_type <> ''",
        f"SELECT 'employment', employment_type FROM jobs WHERE {where} AND employment_type <> ''",
        f"SELECT 'company', company FROM jobs WHERE {where} AND company <> ''",
        f"SELECT 'source', provider FROM jobs WHERE {where} AND provider <> ''",
    ]
    return " UNION ALL ".join(parts)


@query(
    "a20_filtered_facets",
    _CLIENT_SQL + f'SELECT "group", value, CAST(count(*) AS BIGINT) AS count FROM ({_facet_rows(_FILTERED)}) WHERE value IS NOT NULL GROUP BY 1, 2',
)
def a20_filtered(spark, sf):
    jobs = client(spark, sf).withColumn("number", F.col("id").cast("bigint"))
    # Two days of jobs, whose bitmaps are merged.
    days = [facet_bitmaps.bitmaps(jobs.where(F.expr(f"number % 2 = {half}")), ORDERS_AS_OF) for half in (0, 1)]
    stored = cut_lineage(facet_bitmaps.merge(*days), spark.sparkContext.getCheckpointDir())
    return facet_bitmaps.counts(stored, {"workplace": ["remote"], "source": ["ashby", "gem"]})


@query("a24_distinct_skills", _CLIENT_SQL + "SELECT DISTINCT unnest(skills) AS value FROM jobs")
def a24(spark, sf):
    return search.distinct_values(client(spark, sf), "skills")


@query("a25_result_counts", _CLIENT_SQL + "SELECT count(*) AS jobs, count(DISTINCT company) AS companies FROM jobs")
def a25(spark, sf):
    return search.result_counts(client(spark, sf))


@query(
    "o6_search_page",
    _CLIENT_SQL + "SELECT id, company FROM jobs ORDER BY created_at DESC NULLS LAST, id LIMIT 12 OFFSET 24",
)
def o6(spark, sf):
    return search.page(client(spark, sf), 3).select("id", "company")


@query(
    "x24_hours_old",
    cte("jobs") + f"""SELECT job_id, CASE WHEN posted_at IS NULL THEN TRUE ELSE FALSE END AS undated,
  round(CASE WHEN posted_at IS NULL THEN -1 ELSE greatest(0, epoch(TIMESTAMP '{EVENTS_AS_OF}' - posted_at) / 3600.0) END, 3) AS hours FROM jobs""",
)
def x24(spark, sf):
    hours = fn.hours_old(F.col("posted_at"), fn.instant(EVENTS_AS_OF))
    undated = hours == float("inf")
    return standin(spark, sf, "jobs").select(
        "job_id", undated.alias("undated"), F.round(F.when(undated, -1.0).otherwise(hours), 3).alias("hours")
    )


# --- runs -------------------------------------------------------------------

_SECONDS = f"epoch(coalesce(finished_at, {_T}) - started_at)"


def runs(spark, sf):
    return run.with_duration(standin(spark, sf, "runs"), ORDERS_AS_OF)


@query("p25_run_durations", cte("runs") + f"SELECT run_id, status, CAST({_SECONDS} AS DOUBLE) AS duration_seconds FROM runs")
def p25(spark, sf):
    return runs(spark, sf).select("run_id", "status", "duration_seconds")


@query(
    "o7_newest_runs",
    cte("runs") + f"SELECT run_id, strftime(started_at, '{TS}') AS started_at FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 25 OFFSET 50",
)
def o7(spark, sf):
    return plain(run.newest_runs(standin(spark, sf, "runs"), ORDERS_AS_OF, 25, 50).select("run_id", "started_at"))


@query(
    "a22_run_history",
    cte("runs")
    + f"""SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'success') / CAST(count(*) FILTER (WHERE status <> 'running') AS DOUBLE) AS success_rate,
  round(avg({_SECONDS}) FILTER (WHERE status <> 'running'), 6) AS mean_duration_seconds, count(*) FILTER (WHERE status = 'failed') AS failed_runs FROM runs""",
)
def a22(spark, sf):
    history = run.run_history(runs(spark, sf))
    return history.withColumn("mean_duration_seconds", F.round("mean_duration_seconds", 6))


@query(
    "f17_filtered_runs",
    cte("runs") + "SELECT run_id FROM runs WHERE status = 'failed' AND contains(lower('#' || run_id || ' ' || status || ' ' || coalesce(error, '')), 'timeout at 2')",
)
def f17(spark, sf):
    return run.filter_runs(standin(spark, sf, "runs"), "failed", "Timeout at 2").select("run_id")


@query(
    "c15_run_status",
    cte("runs")
    + """SELECT run_id, CASE WHEN coalesce(sources_failed, 0) > 0 OR enrichments_failed > 0 THEN 'partial_success' ELSE 'success' END AS outcome,
  CAST(coalesce(sources_failed, 0) + enrichments_failed AS BIGINT) AS failed_operations FROM runs""",
)
def c15(spark, sf):
    failures = F.coalesce("sources_failed", F.lit(0))
    return plain(
        standin(spark, sf, "runs").select(
            "run_id",
            run.run_status(failures, F.col("enrichments_failed")).alias("outcome"),
            run.failed_operations().alias("failed_operations"),
        )
    )


_CRAWLS_SQL = cte("crawls", "sources", "companies") + f""", crawled AS (SELECT cr.*, s.provider, s.canonical_url, s.company_id, c.name AS company_name,
  CAST(epoch(coalesce(finished_at, {_T}) - started_at) AS DOUBLE) AS duration_seconds,
  CASE WHEN cr.status = 'failed' OR coalesce(error, '') <> '' THEN 'failed' WHEN coalesce(warning, '') <> '' OR deactivation_skipped THEN 'warning' ELSE 'success' END AS kind
FROM crawls cr LEFT JOIN sources s USING (source_id) LEFT JOIN companies c ON c.company_id = s.company_id)
"""


def crawled(spark, sf):
    return run.crawl_rows(*[standin(spark, sf, n) for n in ("crawls", "sources", "companies")], ORDERS_AS_OF)


@query(
    "j15_crawl_rows",
    _CRAWLS_SQL + "SELECT crawl_run_id, source_id, provider, canonical_url, company_id, company_name, duration_seconds, kind AS crawl_class FROM crawled",
)
def j15(spark, sf):
    return crawled(spark, sf).select(
        "crawl_run_id", "source_id", "provider", "canonical_url", "company_id", "company_name", "duration_seconds",
        run.crawl_class().alias("crawl_class"),
    )


@query(
    "f18_filtered_crawls",
    _CRAWLS_SQL + "SELECT crawl_run_id FROM crawled WHERE kind = 'warning' AND contains(lower(coalesce(company_name, '') || ' ' || coalesce(provider, '') || ' ' || coalesce(canonical_url, '') || ' ' || source_id), 'nation_1')",
)
def f18(spark, sf):
    return run.filter_crawls(crawled(spark, sf), "warning", "Nation_1").select("crawl_run_id")


@query(
    "c04_crawl_classes",
    _CRAWLS_SQL + "SELECT kind AS crawl_class, count(*) AS n, count(*) FILTER (WHERE coalesce(warning, '') <> '' OR deactivation_skipped) AS warning_crawls FROM crawled GROUP BY 1",
)
def c04(spark, sf):
    kinds = standin(spark, sf, "crawls").withColumn("crawl_class", run.crawl_class())
    warned = F.count(F.when(run.crawl_warned(), 1)).alias("warning_crawls")
    return kinds.groupBy("crawl_class").agg(F.count(F.lit(1)).alias("n"), warned)


@query(
    "f15_filtered_logs",
    cte("logs") + "SELECT log_id, message FROM logs WHERE stage = 'crawl' AND upper(level) = 'WARNING' AND contains(lower(logger || ' ' || message || ' ' || coalesce(exception, '')), 'value 1')",
)
def f15(spark, sf):
    return run.filter_logs(standin(spark, sf, "logs"), stage="crawl", level="Warning", query="VALUE 1").select("log_id", "message")


@query(
    "o8_logs_in_time_order",
    cte("logs") + "SELECT log_id, level FROM logs WHERE contains(lower(logger || ' ' || message || ' ' || coalesce(exception, '')), 'timeout') ORDER BY created_at, log_id LIMIT 200 OFFSET 10",
)
def o8(spark, sf):
    found = run.filter_logs(standin(spark, sf, "logs"), query="Timeout")
    return run.in_time_order(found, "created_at", "log_id").offset(10).limit(200).select("log_id", "level")


@query("f23_issue_events", cte("logs") + "SELECT log_id, severity FROM logs WHERE severity IN ('critical', 'error', 'warning') AND stage = 'enrichment'")
def f23(spark, sf):
    return run.issue_events(standin(spark, sf, "logs"), "enrichment").select("log_id", "severity")


@query("a23_severity_counts", cte("logs") + "SELECT severity, count(*) AS n FROM logs GROUP BY 1")
def a23(spark, sf):
    return run.severity_counts(standin(spark, sf, "logs"))


_METRICS = (
    "CASE event_type WHEN 'click' THEN '{\"input_tokens\": \"' || CAST(user_id AS STRING) || '\", \"ai_calls\": 2, \"tokens\": {\"input\": 7, \"thought\": 9}}' "
    "WHEN 'view' THEN '{\"tokens\": {\"input\": ' || CAST(user_id AS STRING) || ', \"reasoning\": 4}, \"input_tokens\": \"many\"}' ELSE '[]' END"
)


@query(
    "p26_token_metrics",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS DOUBLE) END AS input_tokens,
  CASE event_type WHEN 'click' THEN CAST(9 AS DOUBLE) WHEN 'view' THEN CAST(4 AS DOUBLE) END AS thought_tokens,
  CASE event_type WHEN 'click' THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ai_calls FROM events""",
)
def p26(spark, sf):
    stages = table(spark, sf, "events").select("event_id", F.expr(_METRICS).alias("metrics"))
    return run.token_metrics(stages).select("event_id", "input_tokens", "thought_tokens", "ai_calls")


def _used(tokens: str) -> str:
    """Tokens of completed and stale results; other rows made no call that returned usage."""
    return f"CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN {tokens} END"


_USAGE_COLUMNS = {
    "outcome": "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'failed' ELSE 'stale' END "
    "ELSE CASE l_linestatus WHEN 'O' THEN 'skipped_non_us' ELSE 'not_eligible' END END",
    "model": "CASE WHEN l_linenumber < 5 THEN 'model ' || CAST(l_linenumber AS STRING) END",
    "input_tokens": _used("CAST(l_quantity AS BIGINT)"),
    "output_tokens": _used("CAST(l_quantity AS BIGINT) * 2"),
    "thought_tokens": _used("CAST(0 AS BIGINT)"),
    "cached_tokens": _used("CAST(1 AS BIGINT)"),
    "total_tokens": _used("CAST(l_quantity AS BIGINT) * 3"),
}
_USAGE = ", ".join(f"{e} AS {c}" for c, e in _USAGE_COLUMNS.items())


def usage(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _USAGE_COLUMNS.items()])


_OUTCOMES_SQL = (
    f"""WITH d AS (SELECT {_USAGE} FROM lineitem) SELECT count(*) AS processed, count(*) FILTER (WHERE outcome IN ('completed', 'failed')) AS model_calls,
  count(*) FILTER (WHERE outcome IN ('completed', 'skipped_non_us', 'not_eligible')) AS completed, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  count(*) FILTER (WHERE outcome = 'stale') AS stale, count(*) FILTER (WHERE outcome = 'skipped_non_us') AS skipped_non_us,
  """
    + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "thought_tokens", "cached_tokens", "total_tokens"))
    + " FROM d"
)


@query("a16_enrichment_summary", _OUTCOMES_SQL)
def a16(spark, sf):
    return run.enrichment_summary(usage(spark, sf))


@query("a16_summary_as_written", _OUTCOMES_SQL)
def a16_written(spark, sf):
    return append_counted(usage(spark, sf), scratch(spark, "outcomes"), run.enrichment_figures())


@query(
    "a16_model_counts",
    f"WITH d AS (SELECT {_USAGE} FROM lineitem) SELECT coalesce(model, 'unknown') AS model, count(*) AS n FROM d WHERE total_tokens IS NOT NULL GROUP BY 1",
)
def a16_models(spark, sf):
    return run.model_counts(usage(spark, sf))


@query(
    "a26_system_health",
    cte("runs", "sources", "queue", "snapshots")
    + f""", last AS (SELECT status, finished_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1)
SELECT CASE WHEN last.status IN ('success', 'partial_success') THEN 'ok' ELSE 'degraded' END AS status, last.status AS last_pipeline_status,
  strftime(last.finished_at, '{TS}') AS last_pipeline_finish_time, (SELECT count(*) FROM sources WHERE status = 'active') AS active_source_count,
  (SELECT count(*) FROM queue WHERE status = 'pending') AS enrichment_backlog, (SELECT CAST(max(snapshot_date) AS VARCHAR) FROM snapshots) AS latest_snapshot_date FROM last""",
)
def a26(spark, sf):
    return plain(
        run.system_health(standin(spark, sf, "runs"), standin(spark, sf, "sources"), standin(spark, sf, "queue"), snapshots(spark, sf))
    )


# --- streams ----------------------------------------------------------------


@query(
    "r2_streamed_daily_counts",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def r2(spark, sf):
    folder = scratch(configure(spark), "daily-counts")
    stream = (
        spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
        .selectExpr("ts AS occurred_at", "event_type")
    )
    counts = crawl_stream.counts_table(spark, f"counts_{uuid.uuid4().hex}", f"{folder}/counts", buckets=4)
    started = (
        crawl_stream.daily_event_counts(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(crawl_stream.keyed_sink(counts, cut_lineage))
        .start()
    )
    started.awaitTermination()
    return plain(counts.read().drop("batch"))


# Weekly crawls of three sources from the event table: a posting is a value of
# ``k`` seen in the week, its content the least event type.  One crawl failed.
_CRAWL_WEEKS = "user_id % 3 AS source_id, CAST(date_trunc('week', ts) AS DATE) AS week"
_FAILED = "source_id = 1 AND week = DATE '2024-01-15'"
_R1_SQL = f"""WITH seen AS (SELECT {_CRAWL_WEEKS}, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(event_type) AS hash FROM events GROUP BY 1, 2, 3),
crawls AS (SELECT source_id, week, row_number() OVER (PARTITION BY source_id ORDER BY week) AS seq, count(*) OVER (PARTITION BY source_id) AS crawls
  FROM (SELECT DISTINCT source_id, week FROM seen WHERE NOT ({_FAILED}))),
steps AS (SELECT s.*, c.seq, c.crawls, lag(c.seq) OVER w AS before, lead(c.seq) OVER w AS after, lag(s.hash) OVER w AS old
  FROM seen s JOIN crawls c USING (source_id, week) WINDOW w AS (PARTITION BY s.source_id, s.k ORDER BY c.seq))
SELECT source_id, 'job ' || k AS external_job_id, max(seq) = max(crawls) AS active, arg_max(hash, seq) AS content_hash,
  strftime(CAST(min(week) AS TIMESTAMP), '{TS}') AS first_seen_at, strftime(CAST(max(week) AS TIMESTAMP), '{TS}') AS last_seen_at,
  count(*) FILTER (WHERE before IS NULL) AS created, count(*) FILTER (WHERE old <> hash) AS changed,
  count(*) FILTER (WHERE before < seq - 1) AS reactivated,
  count(*) FILTER (WHERE seq < crawls AND coalesce(after, 0) <> seq + 1) AS removed
FROM steps GROUP BY source_id, k"""


def _crawl_files(spark, sf, name):
    """Folders of a stream, its manifest and its postings, from the event table."""
    folder = scratch(spark, name)
    folders = crawl_stream.Folders(f"{folder}/manifest", f"{folder}/postings", f"{folder}/sources", f"{folder}/state")
    weeks = table(spark, sf, "events").selectExpr("user_id % 3 AS source_id", "CAST(date_trunc('week', ts) AS DATE) AS week",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "event_type")
    seen = weeks.groupBy("source_id", "week", "k").agg(F.min("event_type").alias("content_hash"))
    seen = seen.withColumn("crawl_run_id", F.datediff("week", F.lit("2020-01-01")) * 10 + F.col("source_id"))
    found = seen.groupBy("crawl_run_id", "source_id", "week").agg(F.count(F.lit(1)).alias("job_count"))
    status = F.when(F.expr(_FAILED), "failed").otherwise("success")
    manifest = found.withColumns({"status": status, "started_at": F.col("week").cast("timestamp"), "error": F.when(status == "failed", "HTTP 500")})
    postings = seen.where(f"NOT ({_FAILED})").withColumns(
        {"pos": F.col("k"), "external_job_id": F.concat(F.lit("job "), "k"), "title": F.col("content_hash"), "provider": F.lit("lever")}
    )
    sources = spark.range(3).select(F.col("id").alias("source_id"), F.lit("active").alias("status"))
    _shaped(sources, SOURCE_SCHEMA).write.parquet(folders.sources)
    return folders, _shaped(manifest, crawl_stream.MANIFEST_SCHEMA), _shaped(postings, crawl_stream.POSTING_SCHEMA)


def _shaped(df, schema):
    fields = [c.split() for c in schema.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def _streamed_jobs(spark, folders):
    jobs = crawl_stream.current_state(spark, folders, "jobs", JOB_SCHEMA)
    kinds = ("created", "changed", "reactivated", "removed")
    events = spark.read.parquet(f"{folders.root}/events/*").groupBy("job_id").agg(
        *[F.count(F.when(F.col("event_type") == kind, 1)).alias(kind) for kind in kinds]
    )
    columns = ("source_id", "external_job_id", "active", "content_hash", "first_seen_at", "last_seen_at")
    return plain(jobs.join(events, "job_id", "left").select(*columns, *kinds))


@query("r1_streamed_lifecycle", _R1_SQL)
def r1(spark, sf):
    folders, manifest, postings = _crawl_files(spark, sf, "lifecycle")
    postings.repartition(5).write.parquet(folders.postings)
    manifest.repartition(3).write.parquet(folders.manifest)
    crawl_stream.start_lifecycle(spark, folders, cut_lineage, parts=4, min_previous=1 << 40).awaitTermination()
    return _streamed_jobs(spark, folders)


# The same crawls when half of the postings come first, and all of them again later,
# with the rule on sudden drops: below 0.95 of the trusted count nothing is removed.
_R1_LATE_SQL = f"""WITH RECURSIVE seen AS (SELECT {_CRAWL_WEEKS}, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(event_type) AS hash FROM events GROUP BY 1, 2, 3),
crawls AS (SELECT source_id, week, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY week) AS seq, count(*) OVER (PARTITION BY source_id) AS crawls
  FROM seen WHERE NOT ({_FAILED}) GROUP BY source_id, week),
walk AS (SELECT source_id, seq, n AS trusted, 1 AS removes FROM crawls WHERE seq = 1
  UNION ALL SELECT c.source_id, c.seq, CASE WHEN w.trusted >= 20 AND c.n < w.trusted * 0.95 THEN w.trusted ELSE c.n END,
    CASE WHEN w.trusted >= 20 AND c.n < w.trusted * 0.95 THEN 0 ELSE 1 END
  FROM walk w JOIN crawls c ON c.source_id = w.source_id AND c.seq = w.seq + 1),
sums AS (SELECT source_id, seq, sum(removes) OVER (PARTITION BY source_id ORDER BY seq) AS removals FROM walk),
steps AS (SELECT s.*, c.seq, m.removals, lag(m.removals) OVER w AS before, lead(m.removals) OVER w AS after, lead(c.seq) OVER w AS next_seq, lag(s.hash) OVER w AS old, own.removes
  FROM seen s JOIN crawls c USING (source_id, week) JOIN sums m ON m.source_id = c.source_id AND m.seq = c.seq JOIN walk own ON own.source_id = c.source_id AND own.seq = c.seq
  WINDOW w AS (PARTITION BY s.source_id, s.k ORDER BY c.seq)),
ends AS (SELECT source_id, max(removals) AS whole FROM sums GROUP BY source_id),
gaps AS (SELECT t.*, e.whole, t.before < t.removals - t.removes AS was_removed,
    CASE WHEN t.next_seq IS NULL THEN e.whole > t.removals ELSE t.after - (SELECT removes FROM walk x WHERE x.source_id = t.source_id AND x.seq = t.next_seq) > t.removals END AS gets_removed
  FROM steps t JOIN ends e USING (source_id))
SELECT source_id, 'job ' || k AS external_job_id, NOT arg_max(gets_removed, seq) AS active, arg_max(hash, seq) AS content_hash,
  strftime(CAST(min(week) AS TIMESTAMP), '{TS}') AS first_seen_at, strftime(CAST(max(week) AS TIMESTAMP), '{TS}') AS last_seen_at,
  count(*) FILTER (WHERE before IS NULL) AS created, count(*) FILTER (WHERE old <> hash) AS changed,
  count(*) FILTER (WHERE was_removed) AS reactivated, count(*) FILTER (WHERE gets_removed) AS removed
FROM gaps GROUP BY source_id, k"""


@query("r1_late_crawls", _R1_LATE_SQL)
def r1_late(spark, sf):
    folders, manifest, postings = _crawl_files(spark, sf, "late-crawls")
    early = F.col("started_at") < "2024-01-15"
    runs = [(manifest.where(early), postings.where("pos % 2 = 0")), (manifest, postings)]
    for rows, found in runs:
        found.repartition(3).write.mode("append").parquet(folders.postings)
        rows.coalesce(1).write.mode("append").parquet(folders.manifest)
        crawl_stream.start_lifecycle(spark, folders, cut_lineage, parts=4, min_ratio=0.95).awaitTermination()
    return _streamed_jobs(spark, folders)
