"""Source inventory over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import scalar as fn
from hirelake.functions.unicode import display_name, name_key, name_slug
from hirelake.operators import companies as comp, inventory as inv
from hirelake.plans.company_queries import TS
from hirelake.plans.registry import query
from hirelake.plans.standins import ORDERS_AS_OF, cte, plain, standin, stored, table
from hirelake.session import cut_lineage, scratch
from hirelake.sources.inventory import csv_candidates, parquet_candidates, unique_inventory, url_inventory
from hirelake.sources.store import absent, append_counted

_T = f"TIMESTAMP '{ORDERS_AS_OF}'"

# Two candidate feeds: a CSV-like one from orders, a company table from customers.
_CSV = {
    "ats_platform": "CASE o_orderstatus WHEN 'O' THEN ' Greenhouse ' WHEN 'F' THEN 'AshbyHQ' ELSE 'Zoho Recruit' END",
    "canonical_url": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' "
    "THEN 'ftp://boards.example/c' || CAST(o_custkey AS STRING) WHEN o_totalprice < 60000 THEN 'https://boards.example' "
    "ELSE ' HTTPS://boards.example//c' || CAST(o_custkey AS STRING) || '/jobs?page=1 ' END",
    "company_name": "CASE WHEN o_totalprice < 100000 THEN '  ' ELSE ' Company ' || CAST(o_orderkey AS STRING) END",
    "pos": "o_orderkey",
}
_PARQUET = {
    "ats": "CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' WHEN 'HOUSEHOLD' THEN 'zoho' "
    "WHEN 'FURNITURE' THEN ' ' ELSE 'gem' END",
    "slug": "' c' || CAST(c_custkey AS STRING)",
    "name": "CASE WHEN c_acctbal > 0 THEN c_name END",
    "career_url": "CASE WHEN c_acctbal > 5000 THEN 'https://careers.example/' || lower(c_mktsegment) ELSE 'n/a' END",
    "pos": "c_custkey",
}


def _select(spark, sf, name, columns):
    return table(spark, sf, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def feeds(spark, sf):
    return csv_candidates(_select(spark, sf, "orders", _CSV)), parquet_candidates(_select(spark, sf, "customer", _PARQUET))


def _cte(name: str, given: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {given})"


_PROVIDER = (
    "CASE lower(trim({0})) WHEN 'ashbyhq' THEN 'ashby' WHEN 'breezy hr' THEN 'breezy' WHEN 'hrm direct' THEN 'hrm_direct' "
    "WHEN 'oracle cloud hcm' THEN 'oracle_hcm' WHEN 'zoho recruit' THEN 'zoho' ELSE lower(trim({0})) END"
)
_URL = "CASE WHEN regexp_matches(trim({0}), '(?i)^https?://[^/?#]') THEN trim({0}) END"
_SEGMENT = "nullif(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*/+([^/?#;]+)', 1), '')"
_FEEDS_SQL = (
    "WITH "
    + _cte("raw_csv", "orders", _CSV)
    + ",\n"
    + _cte("raw_parquet", "customer", _PARQUET)
    + f""", csv AS (SELECT {_PROVIDER.format('ats_platform')} AS provider, {_URL.format('canonical_url')} AS canonical_url,
    nullif(trim(company_name), '') AS company_name, pos FROM raw_csv),
csv_feed AS (SELECT *, coalesce({_SEGMENT.format('canonical_url')}, '') AS source_slug FROM csv),
parquet_feed AS (SELECT {_PROVIDER.format('ats')} AS provider, trim(slug) AS source_slug, {_URL.format('career_url')} AS canonical_url,
    nullif(trim(name), '') AS company_name, pos FROM raw_parquet)
"""
)
_MERGED_SQL = (
    _FEEDS_SQL
    + f""", grouped AS (
  SELECT provider, source_slug,
    arg_min(canonical_url, pos) FILTER (WHERE origin = 'csv' AND canonical_url IS NOT NULL) AS csv_url,
    arg_min(canonical_url, pos) FILTER (WHERE origin = 'parquet' AND canonical_url IS NOT NULL) AS parquet_url,
    arg_min(company_name, pos) FILTER (WHERE origin = 'csv' AND company_name IS NOT NULL) AS csv_name,
    arg_min(company_name, pos) FILTER (WHERE origin = 'parquet' AND company_name IS NOT NULL) AS parquet_name,
    bool_or(origin = 'csv') AS in_csv, bool_or(origin = 'parquet') AS in_parquet, count(*) AS rows_merged
  FROM (SELECT 'csv' AS origin, provider, source_slug, canonical_url, company_name, pos FROM csv_feed
    UNION ALL SELECT 'parquet', provider, source_slug, canonical_url, company_name, pos FROM parquet_feed)
  WHERE provider <> '' AND source_slug <> '' GROUP BY 1, 2),
merged AS (SELECT provider, source_slug, coalesce(csv_url, parquet_url) AS canonical_url, coalesce(parquet_name, csv_name) AS company_name,
    coalesce(CASE WHEN provider IN ('greenhouse', 'ashby', 'lever') THEN {_SEGMENT.format('coalesce(csv_url, parquet_url)')} END, source_slug) AS board_id,
    in_csv, in_parquet, rows_merged FROM grouped)
"""
)


def merged(spark, sf):
    return inv.merge_candidates(*feeds(spark, sf))


@query(
    "s01_csv_candidates",
    _FEEDS_SQL
    + "SELECT pos, provider, source_slug, canonical_url, company_name, provider <> '' AND source_slug <> '' AS is_valid FROM csv_feed",
)
def s01(spark, sf):
    return feeds(spark, sf)[0].drop("origin")


@query(
    "s01_csv_feed_counts",
    _FEEDS_SQL + "SELECT count(*) AS rows_read, count(*) FILTER (WHERE provider = '' OR source_slug = '') AS skipped FROM csv_feed",
)
def s01_counts(spark, sf):
    return inv.feed_counts(feeds(spark, sf)[0])


@query(
    "s02_table_candidates",
    _FEEDS_SQL
    + "SELECT pos, provider, source_slug, canonical_url, company_name, provider <> '' AND source_slug <> '' AS is_valid FROM parquet_feed",
)
def s02(spark, sf):
    return feeds(spark, sf)[1].drop("origin")


@query("a13_merge_candidates", _MERGED_SQL + "SELECT * FROM merged")
def a13(spark, sf):
    return merged(spark, sf)


@query(
    "o9_sorted_candidates",
    _MERGED_SQL + "SELECT provider, source_slug, board_id FROM merged ORDER BY provider, source_slug",
)
def o9(spark, sf):
    return merged(spark, sf).select("provider", "source_slug", "board_id").orderBy("provider", "source_slug")


_IMPORT_SQL = (
    _MERGED_SQL
    + """SELECT count(*) AS normalized_candidates, CAST(sum(rows_merged - 1) AS BIGINT) AS duplicates_merged,
  count(*) FILTER (WHERE in_csv AND NOT in_parquet) AS csv_only, count(*) FILTER (WHERE in_parquet AND NOT in_csv) AS parquet_only,
  count(*) FILTER (WHERE in_csv AND in_parquet) AS overlapping,
  count(*) FILTER (WHERE provider IN ('greenhouse', 'ashby', 'lever')) AS supported_pending,
  count(*) FILTER (WHERE provider NOT IN ('greenhouse', 'ashby', 'lever')) AS unsupported_pending,
  count(canonical_url) AS with_canonical_url, count(*) - count(canonical_url) AS without_canonical_url FROM merged"""
)


@query("a14_import_report", _IMPORT_SQL)
def a14(spark, sf):
    return inv.import_report(merged(spark, sf))


@query("a14_report_as_written", _IMPORT_SQL)
def a14_written(spark, sf):
    return append_counted(merged(spark, sf), scratch(spark, "candidates"), inv.import_figures())


@query("a14_provider_counts", _MERGED_SQL + "SELECT provider, count(*) AS n FROM merged GROUP BY 1")
def a14_providers(spark, sf):
    return inv.provider_counts(merged(spark, sf))


@query(
    "u03_origin_membership",
    _MERGED_SQL
    + "SELECT CASE WHEN in_csv AND in_parquet THEN 'both' WHEN in_csv THEN 'csv' ELSE 'parquet' END AS origin, count(*) AS n FROM merged GROUP BY 1",
)
def u03(spark, sf):
    origin = F.when(F.col("in_csv") & F.col("in_parquet"), "both").when(F.col("in_csv"), "csv").otherwise("parquet")
    return merged(spark, sf).groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


# Candidates already staged, from customers.
_STAGED = {
    "candidate_id": "c_custkey",
    "provider": "CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' ELSE 'zoho' END",
    "source_slug": "'c' || CAST(c_custkey AS STRING)",
    "canonical_url": "CASE WHEN c_acctbal > 2000 THEN 'https://old.example/c' || CAST(c_custkey AS STRING) END",
    "board_id": "CASE WHEN c_acctbal > 4000 THEN 'old-board' END",
    "company_name": "'Old ' || c_name",
    "status": "CASE WHEN c_acctbal > 7000 THEN 'promoted' WHEN c_acctbal > 3000 THEN 'valid' WHEN c_acctbal > 0 THEN 'pending' ELSE 'invalid' END",
    "validation_error": "CASE WHEN c_acctbal <= 0 THEN 'HTTP 404' END",
    "validation_attempts": "CASE WHEN c_acctbal > 0 THEN 1 ELSE 2 END",
    "last_validated_at": "CASE WHEN c_acctbal > 1000 THEN TIMESTAMP '1998-07-31 23:50:00' WHEN c_acctbal > 0 THEN TIMESTAMP '1998-07-31 12:00:00' END",
    "updated_at": "CASE WHEN c_acctbal > -100000 THEN TIMESTAMP '1998-07-31 12:00:00' END",
}


def staged(spark, sf):
    return _select(spark, sf, "customer", _STAGED)


_STAGED_SQL = _MERGED_SQL + ", " + _cte("staged", "customer", _STAGED) + "\n"
_SUPPORTED = "IN ('greenhouse', 'ashby', 'lever')"


@query(
    "s08_upsert_candidates",
    _STAGED_SQL
    + f"""SELECT coalesce(s.provider, m.provider) AS provider, coalesce(s.source_slug, m.source_slug) AS source_slug,
  coalesce(m.canonical_url, s.canonical_url) AS canonical_url, coalesce(m.board_id, s.board_id) AS board_id,
  coalesce(m.company_name, s.company_name) AS company_name,
  CASE WHEN m.provider IS NULL OR s.provider {_SUPPORTED} THEN s.status ELSE 'pending' END AS status,
  CASE WHEN m.provider IS NULL OR s.provider {_SUPPORTED} THEN s.validation_error END AS validation_error,
  CAST(CASE WHEN m.provider IS NULL OR s.provider {_SUPPORTED} THEN s.validation_attempts ELSE 0 END AS BIGINT) AS validation_attempts,
  strftime(CASE WHEN m.provider IS NULL THEN s.updated_at ELSE {_T} END, '{TS}') AS updated_at
FROM staged s FULL JOIN merged m ON m.provider = s.provider AND m.source_slug = s.source_slug""",
)
def s08(spark, sf):
    candidates = stored(spark, staged(spark, sf), ("provider", "source_slug"))
    fresh = cut_lineage(merged(spark, sf), spark.sparkContext.getCheckpointDir())
    candidates.rewrite(fresh, lambda rows, new: inv.upsert_candidates(rows, new, ORDERS_AS_OF))
    return plain(candidates.read().drop("candidate_id", "last_validated_at"))


@query(
    "u02_new_and_known_keys",
    _STAGED_SQL
    + """SELECT count(*) FILTER (WHERE s.provider IS NULL) AS inserted, count(s.provider) AS updated
FROM merged m LEFT JOIN staged s ON m.provider = s.provider AND m.source_slug = s.source_slug""",
)
def u02(spark, sf):
    return inv.insert_counts(merged(spark, sf), staged(spark, sf))


@query(
    "s09_upsert_sources",
    _STAGED_SQL
    + """SELECT coalesce(s.provider, m.provider) AS provider, coalesce(s.source_slug, m.source_slug) AS source_slug,
  coalesce(m.canonical_url, s.canonical_url) AS canonical_url, coalesce(m.board_id, s.board_id) AS board_id,
  CASE WHEN s.provider IS NULL THEN 'not_verified' ELSE s.status END AS status
FROM staged s FULL JOIN merged m ON m.provider = s.provider AND m.source_slug = s.source_slug""",
)
def s09(spark, sf):
    sources = staged(spark, sf).select("provider", "source_slug", "canonical_url", "board_id", "status")
    return inv.upsert_sources(sources, merged(spark, sf))


# --- URL inventory from pages -----------------------------------------------

_PAGES = {
    "ats_platform": "CASE WHEN url LIKE '%.com/%' THEN 'Greenhouse' WHEN url LIKE '%.net/%' THEN 'Breezy HR' ELSE 'lever' END",
    "canonical_url": "url",
    "pos": "page_id",
}
_INVENTORY_SQL = (
    "WITH "
    + _cte("raw", "pages", _PAGES)
    + f""", staged AS (SELECT {_PROVIDER.format('ats_platform')} AS provider, {_URL.format('canonical_url')} AS canonical_url, pos FROM raw),
listed AS (SELECT *, CASE WHEN provider {_SUPPORTED} THEN {_SEGMENT.format('canonical_url')} END AS board_id FROM staged),
inventory AS (SELECT *, coalesce(board_id, 'url_' || sha256(canonical_url)) AS source_slug FROM listed WHERE provider <> '' AND canonical_url IS NOT NULL)
"""
)


def pages_inventory(spark, sf):
    return url_inventory(_select(spark, sf, "pages", _PAGES))


@query(
    "s03_url_inventory",
    _INVENTORY_SQL
    + """SELECT provider, canonical_url, arg_max(source_slug, pos) AS source_slug, arg_max(board_id, pos) AS board_id, max(pos) AS pos
FROM inventory GROUP BY 1, 2""",
)
def s03(spark, sf):
    return unique_inventory(pages_inventory(spark, sf))


@query(
    "s10_insert_absent_inventory",
    _INVENTORY_SQL
    + """, known AS (SELECT provider, source_slug, canonical_url FROM inventory WHERE canonical_url LIKE '%#%')
SELECT provider, source_slug, arg_min(canonical_url, pos) AS canonical_url, 'not_verified' AS status FROM inventory i
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.provider = i.provider AND k.canonical_url = i.canonical_url)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.provider = i.provider AND k.source_slug = i.source_slug)
GROUP BY 1, 2""",
)
def s10(spark, sf):
    inventory = pages_inventory(spark, sf)
    known = inventory.filter(F.contains("canonical_url", F.lit("#")))
    fresh = inv.new_inventory(unique_inventory(inventory), known)
    return fresh.select("provider", "source_slug", "canonical_url", "status")


@query(
    "x03_urls_and_slugs",
    f"""SELECT page_id, {_URL.format('url')} AS web_url, {_SEGMENT.format('url')} AS board,
  coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), ''), NULL) AS stored_slug,
  'url_' || sha256(url) AS hashed_slug FROM pages""",
)
def x03(spark, sf):
    none = F.lit(" ")
    return table(spark, sf, "pages").select(
        "page_id",
        fn.web_url("url").alias("web_url"),
        fn.board_slug("url").alias("board"),
        fn.stored_slug(none, none, F.col("url")).alias("stored_slug"),
        fn.inventory_slug(F.lit("workday"), F.col("url")).alias("hashed_slug"),
    )


@query(
    "x19_percent_decoding",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name || '%' WHEN p_size < 20 THEN p_name || '+%zz' ELSE p_name || '+é' END AS decoded FROM part""",
)
def x19(spark, sf):
    encoded = (
        "CASE WHEN p_size < 10 THEN p_name || '%' WHEN p_size < 20 THEN p_name || '+%zz' "
        "ELSE replace(p_name, ' ', '%20') || '+%C3%A9' END"
    )
    return table(spark, sf, "part").select("p_partkey", fn.decode_percent(F.expr(encoded)).alias("decoded"))


# --- stored candidates: repair, duplicates, promotion -----------------------

_STORED = {
    "candidate_id": "o_orderkey",
    "provider": "CASE o_orderstatus WHEN 'O' THEN ' AshbyHQ' WHEN 'F' THEN 'greenhouse' ELSE 'Zoho' END",
    "source_slug": "CASE WHEN o_orderpriority = '1-URGENT' THEN ' c' || CAST(o_custkey AS STRING) WHEN o_orderpriority = '2-HIGH' THEN ' ' END",
    "board_id": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'c' || CAST(o_custkey AS STRING) WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' END",
    "canonical_url": "CASE WHEN o_orderpriority = '5-LOW' THEN '  ' WHEN o_totalprice > 100000 THEN 'https://boards.example/c' || CAST(o_custkey AS STRING) || '?a=b' END",
    "company_name": "CASE WHEN o_totalprice > 200000 THEN 'Company ' || CAST(o_orderkey AS STRING) WHEN o_totalprice > 100000 THEN ' ' END",
    "status": "CASE WHEN o_totalprice > 400000 THEN 'promoted' WHEN o_totalprice > 300000 THEN 'valid' WHEN o_totalprice > 200000 THEN 'validating' "
    "WHEN o_totalprice > 100000 THEN 'pending' ELSE 'invalid' END",
    "validation_attempts": "CAST(o_orderkey % 5 AS INT)",
    "last_validated_at": "CASE WHEN o_totalprice > 150000 THEN o_orderdate END",
}
_REPAIRED_SQL = (
    "WITH "
    + _cte("stored", "orders", _STORED)
    + """, repaired AS (SELECT candidate_id, CASE lower(trim(provider)) WHEN 'ashbyhq' THEN 'ashby' ELSE lower(trim(provider)) END AS provider,
  coalesce(nullif(trim(source_slug), ''), nullif(trim(board_id), ''), nullif(regexp_extract(canonical_url, '^https?://[^/]+/([^/?#]+)', 1), '')) AS source_slug,
  board_id, nullif(trim(canonical_url), '') AS canonical_url, company_name, status, validation_attempts, last_validated_at FROM stored)
"""
)


def repaired(spark, sf):
    return inv.repair_candidates(_select(spark, sf, "orders", _STORED))


@query("x05_repaired_candidates", _REPAIRED_SQL + "SELECT candidate_id, provider, source_slug, canonical_url FROM repaired")
def x05(spark, sf):
    return repaired(spark, sf).select("candidate_id", "provider", "source_slug", "canonical_url")


@query(
    "a12_merge_duplicates",
    _REPAIRED_SQL
    + f"""SELECT min(candidate_id) AS candidate_id, provider, source_slug,
  first(canonical_url ORDER BY canonical_url IS NULL, candidate_id) AS canonical_url,
  CASE WHEN count(*) > 1 THEN coalesce(first(board_id ORDER BY nullif(trim(board_id), '') IS NULL, candidate_id), source_slug) ELSE first(board_id) END AS board_id,
  first(company_name ORDER BY nullif(trim(company_name), '') IS NULL, candidate_id) AS company_name,
  first(status ORDER BY CASE status WHEN 'promoted' THEN 0 WHEN 'valid' THEN 1 WHEN 'validating' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END, candidate_id) AS status,
  CAST(max(validation_attempts) AS BIGINT) AS validation_attempts, strftime(max(last_validated_at), '{TS}') AS last_validated_at
FROM repaired WHERE source_slug IS NOT NULL GROUP BY provider, source_slug
UNION ALL SELECT candidate_id, provider, source_slug, canonical_url, board_id, company_name, status, validation_attempts,
  strftime(last_validated_at, '{TS}') FROM repaired WHERE source_slug IS NULL""",
)
def a12(spark, sf):
    return plain(inv.merge_duplicates(repaired(spark, sf)))


@query(
    "j13_removed_duplicates",
    _REPAIRED_SQL
    + """SELECT candidate_id FROM (SELECT candidate_id, min(candidate_id) OVER (PARTITION BY provider, source_slug) AS keep FROM repaired
  WHERE source_slug IS NOT NULL) WHERE candidate_id <> keep""",
)
def j13(spark, sf):
    rows = repaired(spark, sf)
    return absent(rows, inv.merge_duplicates(rows), ["candidate_id"]).select("candidate_id")


_ELIGIBLE = f"""status IN ('pending', 'valid') AND provider {_SUPPORTED} AND trim(canonical_url) <> ''
  AND (status = 'valid' OR last_validated_at IS NULL OR last_validated_at < {_T} - INTERVAL 15 MINUTE)"""


@query(
    "f20_eligible_candidates",
    "WITH " + _cte("staged", "customer", _STAGED) + f" SELECT candidate_id, status FROM staged WHERE {_ELIGIBLE}",
)
def f20(spark, sf):
    return inv.eligible_candidates(staged(spark, sf), ORDERS_AS_OF).select("candidate_id", "status")


_CHECKS = {
    "candidate_id": "c_custkey",
    "outcome": "CASE WHEN c_nationkey < 12 THEN 'ok' WHEN c_nationkey < 18 THEN 'transient' ELSE 'invalid' END",
    "error": "CASE WHEN c_nationkey >= 12 THEN 'HTTP ' || CAST(400 + c_nationkey AS STRING) END",
}
_RUNNING = {
    "provider": "CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' ELSE 'ashby' END",
    "source_slug": "'c' || CAST(c_custkey AS STRING)",
    "canonical_url": "'https://live.example/c' || CAST(c_custkey AS STRING)",
    "board_id": "'c' || CAST(c_custkey AS STRING)",
    "status": "CASE WHEN c_acctbal > 6000 THEN 'active' ELSE 'inactive' END",
    "last_attempt_at": "CASE WHEN c_acctbal > 6000 THEN TIMESTAMP '1998-07-01 00:00:00' END",
    "last_error": "CASE WHEN c_acctbal <= 6000 THEN 'HTTP 500' END",
}
_TARGET, _ACTIVE = 60, 10
_PLAN_SQL = (
    "WITH "
    + ",\n".join(
        (_cte("staged", "customer", _STAGED), _cte("checks", "customer", _CHECKS), _cte("running", "customer", _RUNNING))
    )
    + f""", tried AS (SELECT s.* EXCLUDE (source_slug), CASE WHEN s.status = 'valid' THEN 'ok' ELSE c.outcome END AS outcome, c.error,
    coalesce(s.board_id, {_SEGMENT.format('s.canonical_url')}) AS source_slug,
    row_number() OVER (ORDER BY CASE WHEN s.status = 'valid' THEN 0 ELSE 1 END, s.candidate_id) AS turn
  FROM staged s JOIN checks c USING (candidate_id) WHERE {_ELIGIBLE.replace('status IN', 's.status IN').replace('(status =', '(s.status =')}),
firsts AS (SELECT provider, source_slug, min(turn) AS turn FROM tried t WHERE outcome = 'ok' AND NOT EXISTS (
    SELECT 1 FROM running r WHERE r.status = 'active' AND r.provider = t.provider AND r.source_slug = t.source_slug) GROUP BY 1, 2),
chosen AS (SELECT turn FROM firsts ORDER BY turn LIMIT {_TARGET - _ACTIVE}),
plan AS (SELECT t.*, t.turn IN (SELECT turn FROM chosen) AS is_transition FROM tried t
  WHERE (SELECT count(*) FROM chosen) < {_TARGET - _ACTIVE} OR t.turn <= (SELECT max(turn) FROM chosen))
"""
)


def promotion_plan(spark, sf):
    checks, running = _select(spark, sf, "customer", _CHECKS), _select(spark, sf, "customer", _RUNNING)
    return inv.plan_promotions(staged(spark, sf), checks, running, _TARGET, _ACTIVE, ORDERS_AS_OF), running


@query("l25_promotion_plan", _PLAN_SQL + "SELECT candidate_id, outcome, source_slug, is_transition FROM plan")
def l25(spark, sf):
    return promotion_plan(spark, sf)[0].select("candidate_id", "outcome", "source_slug", "is_transition")


@query(
    "l25_promotion_summary",
    _PLAN_SQL
    + f"""SELECT CAST({_TARGET} AS BIGINT) AS target, CAST({_ACTIVE} AS BIGINT) AS active_before, {_ACTIVE} + count(*) FILTER (WHERE is_transition) AS active_after,
  count(*) FILTER (WHERE is_transition) AS added, count(*) FILTER (WHERE outcome = 'invalid') AS rejected,
  count(*) FILTER (WHERE NOT is_transition AND outcome <> 'invalid') AS skipped,
  {_ACTIVE} + count(*) FILTER (WHERE is_transition) >= {_TARGET} AS reached FROM plan""",
)
def l25_summary(spark, sf):
    return plain(inv.promotion_summary(promotion_plan(spark, sf)[0], _TARGET, _ACTIVE))


@query(
    "l23_candidates_after_promotion",
    _PLAN_SQL
    + f"""SELECT s.candidate_id, CASE p.outcome WHEN 'ok' THEN 'promoted' WHEN 'invalid' THEN 'invalid' WHEN 'transient' THEN 'pending' ELSE s.status END AS status,
  CASE WHEN p.outcome = 'ok' THEN NULL WHEN p.outcome IS NOT NULL THEN p.error ELSE s.validation_error END AS validation_error,
  CAST(s.validation_attempts + CASE WHEN p.outcome IS NOT NULL AND s.status <> 'valid' THEN 1 ELSE 0 END AS BIGINT) AS validation_attempts,
  strftime(CASE WHEN p.outcome IS NOT NULL THEN {_T} ELSE s.last_validated_at END, '{TS}') AS last_validated_at
FROM staged s LEFT JOIN plan p USING (candidate_id)""",
)
def l23(spark, sf):
    after = inv.apply_promotions(staged(spark, sf), promotion_plan(spark, sf)[0], ORDERS_AS_OF)
    return plain(after.select("candidate_id", "status", "validation_error", "validation_attempts", "last_validated_at"))


@query(
    "l23_sources_after_promotion",
    _PLAN_SQL
    + f""", won AS (SELECT provider, source_slug, arg_max(canonical_url, turn) AS canonical_url FROM plan WHERE outcome = 'ok' GROUP BY 1, 2)
SELECT coalesce(r.provider, w.provider) AS provider, coalesce(r.source_slug, w.source_slug) AS source_slug,
  coalesce(w.canonical_url, r.canonical_url) AS canonical_url, CASE WHEN w.provider IS NOT NULL THEN 'active' ELSE r.status END AS status,
  strftime(CASE WHEN w.provider IS NOT NULL THEN {_T} ELSE r.last_attempt_at END, '{TS}') AS last_attempt_at,
  CASE WHEN w.provider IS NULL THEN r.last_error END AS last_error
FROM running r FULL JOIN won w ON w.provider = r.provider AND w.source_slug = r.source_slug""",
)
def l23_sources(spark, sf):
    plan, running = promotion_plan(spark, sf)
    after = inv.promoted_sources(running, plan, ORDERS_AS_OF)
    return plain(after.select("provider", "source_slug", "canonical_url", "status", "last_attempt_at", "last_error"))


@query(
    "s07_active_sources",
    cte("sources", "companies")
    + """SELECT s.source_id, s.provider, s.canonical_url, s.company_id, c.name AS company_name FROM sources s
LEFT JOIN companies c USING (company_id) WHERE s.status = 'active'""",
)
def s07(spark, sf):
    rows = inv.active_sources(standin(spark, sf, "sources"), standin(spark, sf, "companies"))
    return rows.select("source_id", "provider", "canonical_url", "company_id", "company_name")


@query("a29_active_source_count", cte("sources") + "SELECT count(*) FILTER (WHERE status = 'active') AS active_sources FROM sources")
def a29(spark, sf):
    return inv.count_active(standin(spark, sf, "sources"))


@query(
    "c17_supported_providers",
    cte("sources") + f"SELECT provider, provider {_SUPPORTED} AS supported, count(*) AS n FROM sources GROUP BY 1",
)
def c17(spark, sf):
    return (
        standin(spark, sf, "sources")
        .groupBy("provider", fn.is_supported("provider").alias("supported"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- company identities -----------------------------------------------------

_NAMES = "CASE WHEN p_size < 25 THEN '  ' || upper(p_name) || ' ' ELSE replace(p_name, ' ', '   ') || ' é' END"
_KEYS = f"lower(trim(regexp_replace({_NAMES}, ' +', ' ', 'g')))"


@query(
    "x07_company_name_keys",
    f"""SELECT p_partkey, {_KEYS} AS normalized_name,
  trim(regexp_replace(lower(strip_accents({_NAMES})), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
)
def x07(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.expr(_NAMES).alias("name"))
    return named.select("p_partkey", name_key("name").alias("normalized_name"), name_slug(display_name(F.col("name"))).alias("slug"))


@query(
    "l07_missing_companies",
    f"""WITH names AS (SELECT DISTINCT {_KEYS} AS normalized_name FROM part),
known AS (SELECT DISTINCT lower(p_name) AS normalized_name, replace(lower(p_name), ' ', '-') AS slug FROM part WHERE p_name LIKE '%ring'),
fresh AS (SELECT n.*, trim(regexp_replace(strip_accents(normalized_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM names n
  WHERE normalized_name NOT IN (SELECT normalized_name FROM known))
SELECT normalized_name, left(sha256('company:' || normalized_name), 32) AS company_id,
  CASE WHEN slug IN (SELECT slug FROM known) OR normalized_name <> min(normalized_name) OVER (PARTITION BY slug)
    THEN slug || '-' || left(sha256(normalized_name), 8) ELSE slug END AS slug FROM fresh""",
)
def l07(spark, sf):
    parts = table(spark, sf, "part")
    known = parts.filter("p_name LIKE '%ring'").selectExpr("lower(p_name) AS normalized_name", "replace(lower(p_name), ' ', '-') AS slug")
    added = comp.missing_companies(known.distinct(), parts.select(F.expr(_NAMES).alias("name")), ORDERS_AS_OF)
    return added.select("normalized_name", "company_id", "slug")


@query(
    "l07_assigned_companies",
    cte("order_jobs", "sources", "companies")
    + """SELECT j.job_id, coalesce(CAST(s.company_id AS VARCHAR), CAST(c.company_id AS VARCHAR)) AS company_id,
  CASE WHEN s.company_id IS NOT NULL THEN sc.name ELSE 'Nation_' || right(j.company, 1) END AS company
FROM order_jobs j LEFT JOIN (SELECT source_id, CASE WHEN status = 'active' THEN company_id END AS company_id FROM sources) s USING (source_id)
LEFT JOIN companies sc ON sc.company_id = s.company_id LEFT JOIN companies c ON lower(c.name) = lower('Nation_' || right(j.company, 1))""",
)
def l07_assigned(spark, sf):
    companies = standin(spark, sf, "companies").withColumn("normalized_name", F.lower("name"))
    owned = F.when(F.col("status") == "active", F.col("company_id"))
    sources = standin(spark, sf, "sources").withColumn("company_id", owned)
    postings = standin(spark, sf, "order_jobs").selectExpr(
        "job_id", "source_id", "external_job_id", "'Nation_' || right(company, 1) AS company"
    )
    rows = comp.assign_companies(postings, sources, companies)
    return rows.select("job_id", F.col("company_id").cast("string").alias("company_id"), "company")


@query(
    "l08_linked_sources",
    cte("sources", "order_jobs")
    + """SELECT s.source_id, coalesce(CASE WHEN s.status = 'active' THEN s.company_id END, j.company_id) AS company_id FROM sources s
LEFT JOIN (SELECT source_id, first(job_id ORDER BY first_seen_at, job_id) AS company_id FROM order_jobs GROUP BY 1) j USING (source_id)""",
)
def l08(spark, sf):
    owned = F.when(F.col("status") == "active", F.col("company_id"))
    sources = standin(spark, sf, "sources").withColumn("company_id", owned)
    postings = standin(spark, sf, "order_jobs").selectExpr("source_id", "job_id AS company_id", "struct(first_seen_at, job_id) AS pos")
    return comp.link_sources(sources, postings).select("source_id", "company_id")
