"""The given tables read as hiring data.

Each stand-in is one list of column expressions, used both for the DataFrame
and for the common table expression of the DuckDB check, so that the two sides
start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.session import configure, scratch
from hirelake.sources.buckets import BucketedTable

# Fixed instants that populate every window of the event and order tables.
EVENTS_AS_OF = "2024-01-25 12:00:00"
EVENTS_LATE_AS_OF = "2024-02-20 12:00:00"
ORDERS_AS_OF = "1998-08-01 00:00:00"

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; the explicit schema makes its timestamps UTC instants."""
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# Dialect differences used inside the expressions below.
_SPARK = {"LIST(": "array(", "{k}": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
_DUCKDB = {"LIST(": "list_value(", "{k}": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}


def _dialect(expression: str, words: dict[str, str]) -> str:
    for word, replacement in words.items():
        expression = expression.replace(word, replacement)
    return expression


_PLACES = (
    "CASE user_id % 10 WHEN 0 THEN 'Chicago, IL' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Tbilisi, Georgia' "
    "WHEN 3 THEN 'Atlanta, GA' WHEN 4 THEN 'Georgia, USA' WHEN 5 THEN 'Toronto, Canada' WHEN 6 THEN 'Austin, Texas' "
    "WHEN 7 THEN 'Santa Fe, New Mexico' WHEN 8 THEN 'Berlin, or remote' ELSE NULL END"
)
_ORDER_HASH = "CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END"

# name -> (given table, {column: expression})
STANDINS: dict[str, tuple[str, dict[str, str]]] = {
    "companies": (
        "nation",
        {
            "company_id": "CAST(n_nationkey AS BIGINT)",
            "name": "n_name",
            "slug": "lower(replace(n_name, '_', '-'))",
            "website_domain": "CASE WHEN n_regionkey = 0 THEN NULL ELSE lower(n_name) || '.example' END",
            "tracking_started_at": "CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-01-20 00:00:00' "
            "ELSE TIMESTAMP '2024-01-01 00:00:00' END",
            "created_at": "CASE WHEN n_nationkey >= 0 THEN TIMESTAMP '2023-12-01 00:00:00' END",
        },
    ),
    "jobs": (
        "events",
        {
            "job_id": "event_id",
            "source_id": "user_id",
            "external_job_id": "CAST(event_id AS STRING)",
            "company_id": "user_id % 25",
            "provider": "CASE event_type WHEN 'signup' THEN 'greenhouse' WHEN 'click' THEN 'ashby' ELSE 'lever' END",
            "company": "'Company ' || CAST(user_id % 25 AS STRING)",
            "title": "event_type || ' engineer'",
            "location": _PLACES,
            "employment_type": "CASE WHEN {k} < 30 THEN 'FullTime' WHEN {k} < 60 THEN 'part-time' "
            "WHEN {k} < 80 THEN 'Intern' WHEN {k} < 95 THEN 'gig' END",
            "workplace_type": "CASE WHEN {k} < 25 THEN 'On Location' WHEN {k} < 50 THEN 'Hybrid' "
            "WHEN {k} < 75 THEN 'REMOTE' ELSE 'moon' END",
            "posted_at": "CASE WHEN event_type <> 'error' THEN ts END",
            "posted_at_source": "CASE WHEN event_type = 'signup' THEN 'feed' END",
            "first_seen_at": "ts + INTERVAL '1' HOUR",
            "last_seen_at": "ts + INTERVAL '2' DAY",
            "removed_at": "CASE WHEN event_type = 'purchase' THEN ts + INTERVAL '3' DAY END",
            "active": "event_type <> 'purchase'",
            "is_us_job": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 5 <> 0 END",
            "content_hash": "event_type || '-' || CAST({k} AS STRING)",
            "classification_status": "CASE WHEN {k} < 50 THEN 'ready' WHEN {k} < 75 THEN 'pending' ELSE 'failed' END",
            "classified_content_hash": "CASE WHEN {k} < 40 THEN event_type || '-' || CAST({k} AS STRING) "
            "WHEN {k} < 60 THEN 'older' END",
            "enrichment_eligibility": "CASE WHEN event_type = 'error' OR user_id % 5 = 0 THEN 'not_eligible' "
            "ELSE 'eligible' END",
            "k": "{k}",
        },
    ),
    "job_events": (
        "events",
        {
            "job_id": "event_id",
            "event_type": "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'changed' "
            "WHEN 'purchase' THEN 'removed' WHEN 'view' THEN 'reactivated' ELSE 'noted' END",
            "occurred_at": "ts",
            "metadata": "CASE WHEN {k} % 2 = 0 THEN '{\"baseline\": true}' ELSE '{\"baseline\": false}' END",
        },
    ),
    "sparse_companies": (
        "customer",
        {
            "company_id": "c_custkey",
            "name": "c_name",
            "slug": "lower(c_name)",
            "website_domain": "CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) || '.example' END",
            "tracking_started_at": "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 "
            "THEN TIMESTAMP '1998-07-25 00:00:00' ELSE TIMESTAMP '1998-01-01 00:00:00' END",
        },
    ),
    "order_jobs": (
        "orders",
        {
            "job_id": "o_orderkey",
            "source_id": "o_custkey",
            "external_job_id": "CAST(o_orderkey AS STRING)",
            "company_id": "o_custkey",
            "company": "'Customer ' || CAST(o_custkey AS STRING)",
            "title": "o_orderpriority",
            "location": "CASE WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN 'Toronto, Canada' "
            "WHEN o_orderstatus = 'O' THEN 'Austin, TX' WHEN o_orderstatus = 'F' THEN 'Boston, MA' END",
            "provider": "CASE WHEN o_totalprice < 250000 THEN 'lever' ELSE 'ashby' END",
            "raw_payload": "CASE WHEN o_totalprice >= 250000 AND o_orderpriority = '3-MEDIUM' "
            "THEN '{\"address\": {\"postalAddress\": {\"addressCountry\": \"' || "
            "CASE WHEN o_orderstatus = 'P' THEN 'US' ELSE 'GE' END || '\"}}}' END",
            "us_location_reason": "CASE WHEN o_totalprice < 50000 THEN 'earlier' END",
            "classification_attempts": "CAST(o_orderkey % 4 AS INT)",
            "classification_version": "CASE WHEN o_totalprice < 200000 THEN 'v2' END",
            "classified_at": "CASE WHEN o_totalprice < 200000 THEN o_orderdate END",
            "employment_type": "CASE WHEN o_totalprice > 250000 THEN 'full_time' END",
            "workplace_type": "CASE WHEN o_totalprice > 100000 THEN 'remote' END",
            "posted_at": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END",
            "posted_at_source": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'feed' END",
            "first_seen_at": "o_orderdate + INTERVAL '1' DAY",
            "last_seen_at": "o_orderdate + INTERVAL '10' DAY",
            "removed_at": "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '20' DAY END",
            "active": "o_orderstatus <> 'F'",
            "is_us_job": "CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN FALSE ELSE TRUE END",
            "content_hash": "o_orderstatus",
            "classification_status": "CASE WHEN o_totalprice < 200000 THEN 'ready' WHEN o_totalprice < 300000 "
            "THEN 'pending' WHEN o_totalprice < 350000 THEN 'processing' ELSE 'failed' END",
            "classified_content_hash": "CASE WHEN o_totalprice < 150000 THEN o_orderstatus ELSE 'older' END",
            "classification_started_at": "CASE WHEN o_totalprice > 300000 THEN o_orderdate END",
            "classification_error": "CASE WHEN o_totalprice > 350000 THEN 'failed before' END",
            "enrichment_eligibility": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'not_eligible' ELSE 'eligible' END",
            "enrichment_eligibility_reason": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'non_us' END",
            "description_text": "'Order ' || CAST(o_orderkey AS STRING) || ' of priority ' || o_orderpriority",
            "description_html": "CASE WHEN o_orderstatus = 'O' THEN '<p>' || o_orderpriority || '</p>' END",
            "job_url": "'https://boards.example/' || CAST(o_orderkey AS STRING)",
            "apply_url": "CASE WHEN o_totalprice > 90000 THEN 'https://boards.example/apply/' || CAST(o_orderkey AS STRING) END",
            "observed_new_after": "CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END",
            "observed_new_before": "CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL '1' DAY END",
        },
    ),
    "enrichments": (
        "lineitem",
        {
            "enrichment_id": "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey",
            "job_id": "l_orderkey",
            "content_hash": _ORDER_HASH,
            "schema_version": "CASE WHEN l_linenumber <= 5 THEN 'v3' ELSE 'v2' END",
            "created_at": "l_shipdate",
            "standardized_title": "'Role ' || CAST(l_linenumber AS STRING)",
            "job_family": "CASE WHEN l_quantity < 25 THEN 'engineering' ELSE '' END",
            "seniority": "CASE l_linestatus WHEN 'O' THEN 'senior' ELSE 'unknown' END",
            "workplace_type": "CASE WHEN l_quantity < 10 THEN 'hybrid' WHEN l_quantity < 20 THEN 'unknown' END",
            "employment_type": "CASE WHEN l_quantity < 15 THEN 'contract' END",
            "required_skills": "LIST('Python', 'SQL ' || l_returnflag)",
            "preferred_skills": "LIST('SQL ' || l_linestatus, '  ', 'Python')",
            "domain_tags": "LIST(l_returnflag, l_returnflag, '')",
            "city": "CASE WHEN l_tax > 0.02 THEN 'Austin' END",
            "state": "CASE WHEN l_tax > 0.04 THEN 'Texas' END",
            "country": "CASE WHEN l_tax > 0.06 THEN 'United States' END",
            "skill_count": "CAST(l_quantity AS INT)",
            "years_experience_min": "l_linenumber",
            "years_experience_max": "CASE WHEN l_discount > 0.05 THEN 4 END",
            "salary_min": "l_extendedprice",
            "salary_max": "CASE WHEN l_discount > 0.02 THEN l_extendedprice END",
            "confidence": "l_discount * 11",
            "job_subfamily": "CASE WHEN l_quantity < 30 THEN 'subfamily ' || l_linestatus END",
            "related_roles": "LIST('Related ' || l_returnflag)",
            "role_track": "CASE WHEN l_tax > 0.03 THEN 'track ' || l_returnflag END",
            "leadership_level": "CASE WHEN l_tax > 0.05 THEN 'lead ' || l_linestatus END",
            "role_keywords": "LIST(l_linestatus, 'keyword')",
            "responsibility_tags": "LIST('duty ' || l_returnflag)",
            "skills": "LIST('Python', 'SQL ' || l_returnflag, 'SQL ' || l_linestatus)",
            "soft_skills": "LIST('soft ' || l_linestatus)",
            "education_required": "CASE WHEN l_discount > 0.03 THEN 'required ' || l_returnflag END",
            "education_preferred": "CASE WHEN l_discount > 0.06 THEN 'preferred ' || l_returnflag END",
            "education_level": "CASE WHEN l_quantity < 40 THEN 'bachelor' ELSE 'unknown' END",
            "education_fields": "LIST('field ' || l_returnflag)",
            "certifications": "LIST('cert ' || l_linestatus)",
            "locations": "LIST('place ' || l_returnflag, 'place ' || l_linestatus)",
            "preferred_locations": "LIST('wish ' || l_returnflag)",
            "state_code": "CASE WHEN l_tax > 0.04 THEN 'TX' END",
            "country_code": "CASE WHEN l_tax > 0.06 THEN 'US' END",
            "relocation_available": "l_quantity > 25",
            "salary_currency": "CASE WHEN l_discount > 0.01 THEN 'USD' END",
            "salary_period": "CASE WHEN l_discount > 0.04 THEN 'year' ELSE 'unknown' END",
            "visa_sponsorship": "CASE WHEN l_quantity > 45 THEN 'available' ELSE 'unknown' END",
            "work_authorization_required": "CASE WHEN l_tax > 0.01 THEN l_quantity > 10 END",
            "citizenship_requirement": "CASE WHEN l_tax > 0.07 THEN 'citizen' END",
            "security_clearance_required": "CASE WHEN l_discount > 0.05 THEN l_quantity > 35 END",
            "security_clearance_level": "CASE WHEN l_quantity > 48 THEN 'secret' END",
            "input_tokens": "CAST(l_quantity AS BIGINT)",
            "output_tokens": "CAST(l_quantity AS BIGINT) - 2",
            "thought_tokens": "CAST(0 AS BIGINT)",
            "cached_tokens": "CAST(0 AS BIGINT)",
            "total_tokens": "CAST(l_quantity AS BIGINT)",
        },
    ),
    "job_versions": (
        "lineitem",
        {
            "job_id": "l_orderkey",
            "title": "CASE WHEN l_tax < 0.07 THEN '3-MEDIUM' WHEN l_tax < 0.08 THEN '5-LOW' END",
            "location": "CASE WHEN l_returnflag <> 'R' THEN 'Austin, TX' END",
        },
    ),
    "order_events": (
        "lineitem",
        {
            "job_id": "l_orderkey",
            "event_type": "CASE l_returnflag WHEN 'A' THEN 'changed' WHEN 'N' THEN 'created' ELSE 'removed' END",
            "occurred_at": "l_shipdate",
        },
    ),
    "queue": (
        "orders",
        {
            "queue_id": "CAST(o_orderkey AS STRING)",
            "job_id": "o_orderkey",
            "content_hash": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'stale' ELSE o_orderstatus END",
            "schema_version": "CASE WHEN o_totalprice < 50000 THEN 'v2' ELSE 'v3' END",
            "status": "CASE WHEN o_totalprice < 250000 THEN 'pending' WHEN o_totalprice < 300000 THEN 'processing' "
            "WHEN o_totalprice < 350000 THEN 'completed' WHEN o_totalprice < 450000 THEN 'failed' ELSE 'parked' END",
            "priority": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
            "reason": "CASE WHEN o_orderstatus = 'P' THEN 'changed_job' ELSE 'new_job' END",
            "attempts": "CAST(o_orderkey % 6 AS INT)",
            "created_at": "o_orderdate",
            "started_at": "CASE WHEN o_totalprice BETWEEN 250000 AND 300000 THEN o_orderdate END",
            "completed_at": "CASE WHEN o_totalprice >= 300000 THEN o_orderdate END",
            "next_attempt_at": "CASE WHEN o_totalprice < 100000 THEN o_orderdate - INTERVAL '300' DAY END",
            "last_error": "CASE WHEN o_totalprice >= 350000 THEN 'timeout' END",
            "error_class": "CASE WHEN o_totalprice >= 350000 THEN 'Timeout' END",
            "retryable": "CASE WHEN o_totalprice >= 400000 THEN FALSE WHEN o_totalprice >= 350000 THEN TRUE END",
        },
    ),
    "sources": (
        "customer",
        {
            "source_id": "c_custkey",
            "provider": "CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' "
            "WHEN 'HOUSEHOLD' THEN 'lever' ELSE 'workday' END",
            "canonical_url": "'https://boards.example/' || lower(c_name) || '/jobs'",
            "source_slug": "lower(c_name)",
            "company_id": "CAST(c_nationkey AS BIGINT)",
            "status": "CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal < 6000 THEN 'active' "
            "ELSE 'not_verified' END",
        },
    ),
    "runs": (
        "orders",
        {
            "run_id": "o_orderkey",
            "status": "CASE WHEN o_orderstatus = 'O' THEN 'success' WHEN o_orderstatus = 'F' THEN 'failed' "
            "WHEN o_totalprice < 100000 THEN 'running' ELSE 'partial_success' END",
            "started_at": "o_orderdate",
            "finished_at": "CASE WHEN o_orderstatus <> 'P' OR o_totalprice >= 100000 "
            "THEN o_orderdate + INTERVAL '90' MINUTE END",
            "error": "CASE WHEN o_orderstatus = 'F' THEN 'timeout at ' || o_orderpriority END",
            "sources_failed": "CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority <> '5-LOW' THEN 0 END",
            "enrichments_failed": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
        },
    ),
    "crawls": (
        "orders",
        {
            "crawl_run_id": "o_orderkey",
            "source_id": "o_custkey",
            "pipeline_run_id": "o_orderkey % 100",
            "status": "CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END",
            "started_at": "o_orderdate",
            "finished_at": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL '45' SECOND END",
            "job_count": "CAST(o_totalprice AS BIGINT)",
            "deactivation_skipped": "o_orderpriority = '2-HIGH'",
            "warning": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'mass-drop' WHEN o_orderpriority = '1-URGENT' THEN '' END",
            "error": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'HTTP 500' END",
        },
    ),
    "logs": (
        "events",
        {
            "log_id": "event_id",
            "pipeline_run_id": "user_id",
            "created_at": "ts",
            "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'warning' ELSE 'Info' END",
            "severity": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' "
            "WHEN 'purchase' THEN 'critical' ELSE 'info' END",
            "stage": "CASE user_id % 6 WHEN 0 THEN 'crawl' WHEN 1 THEN 'enrichment' WHEN 2 THEN 'snapshots' "
            "WHEN 3 THEN 'hiring_stats' ELSE NULL END",
            "logger": "'worker.' || event_type",
            "message": "'value ' || CAST({k} AS STRING) || ' seen'",
            "exception": "CASE WHEN event_type = 'error' THEN 'Timeout after ' || CAST({k} AS STRING) END",
        },
    ),
}


def standin(spark: SparkSession, folder: str, name: str) -> DataFrame:
    given, columns = STANDINS[name]
    return table(spark, folder, given).selectExpr(*[f"{_dialect(e, _SPARK)} AS {c}" for c, e in columns.items()])


# Snapshot rows and histograms need an aggregate, so they are spelled out per dialect.
_SNAPSHOT_KEYS = "user_id % 25 AS company_id, CAST(ts AS DATE) AS snapshot_date"


def stored(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...], buckets: int = 16) -> BucketedTable:
    """A bucketed table of a query's own that holds ``rows``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = BucketedTable(spark, f"stored_{uuid.uuid4().hex}", scratch(spark, "stored"), schema, keys, buckets).create()
    table.replace(rows)
    return table


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rows per company from the event table."""
    events = table(spark, folder, "events").selectExpr(
        "user_id % 25 AS company_id", "CAST(ts AS DATE) AS snapshot_date", "event_type", _dialect("{k} AS k", _SPARK)
    )
    kind = F.col("event_type")
    return (
        events.groupBy("company_id", "snapshot_date")
        .agg(
            F.count(F.lit(1)).alias("total_open_jobs"),
            F.count(F.when(kind == "signup", 1)).alias("new_jobs"),
            F.count(F.when(kind == "purchase", 1)).alias("removed_jobs"),
            F.count(F.when(kind == "click", 1)).alias("changed_jobs"),
            F.count(F.when(F.col("k") < 60, 1)).alias("enriched_jobs"),
        )
        .withColumn("enrichment_coverage", F.col("enriched_jobs") / F.col("total_open_jobs"))
    )


def histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Long histograms per company and day from the event table."""
    names = F.array(
        F.struct(F.lit("role").alias("dimension"), F.col("event_type").alias("name")),
        F.struct(F.lit("skill").alias("dimension"), F.concat(F.lit("skill "), F.col("k").cast("string")).alias("name")),
    )
    return (
        table(spark, folder, "events")
        .selectExpr("user_id % 25 AS company_id", "CAST(ts AS DATE) AS snapshot_date", "event_type", _dialect("{k} AS k", _SPARK))
        .select("company_id", "snapshot_date", F.inline(names))
        .groupBy("company_id", "snapshot_date", "dimension", "name")
        .agg(F.count(F.lit(1)).alias("count"))
    )


_SNAPSHOTS_SQL = _dialect(
    f"""snapshots AS (
  SELECT {_SNAPSHOT_KEYS}, count(*) AS total_open_jobs,
         count(*) FILTER (WHERE event_type = 'signup') AS new_jobs,
         count(*) FILTER (WHERE event_type = 'purchase') AS removed_jobs,
         count(*) FILTER (WHERE event_type = 'click') AS changed_jobs,
         count(*) FILTER (WHERE {{k}} < 60) AS enriched_jobs,
         count(*) FILTER (WHERE {{k}} < 60) / CAST(count(*) AS DOUBLE) AS enrichment_coverage
  FROM events GROUP BY 1, 2)""",
    _DUCKDB,
)
_HISTOGRAMS_SQL = _dialect(
    f"""histograms AS (
  SELECT {_SNAPSHOT_KEYS}, 'role' AS dimension, event_type AS name, count(*) AS count
  FROM events GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT {_SNAPSHOT_KEYS}, 'skill', 'skill ' || CAST({{k}} AS STRING), count(*) FROM events GROUP BY 1, 2, 3, 4)""",
    _DUCKDB,
)


def cte(*names: str) -> str:
    """``WITH`` list of the named stand-ins for DuckDB."""
    parts = []
    for name in names:
        if name == "snapshots":
            parts.append(_SNAPSHOTS_SQL)
        elif name == "histograms":
            parts.append(_HISTOGRAMS_SQL)
        else:
            given, columns = STANDINS[name]
            body = ", ".join(f"{_dialect(e, _DUCKDB)} AS {c}" for c, e in columns.items())
            parts.append(f"{name} AS (SELECT {body} FROM {given})")
    return "WITH " + ",\n".join(parts) + "\n"


# --- result shape -----------------------------------------------------------


def plain(df: DataFrame) -> DataFrame:
    """Result columns as types both engines print alike (dates and lists as text)."""

    def shaped(field) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        return c.alias(field.name)

    return df.select(*[shaped(f) for f in df.schema.fields])
