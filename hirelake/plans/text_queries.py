"""Texts, market scope, payloads and enrichment records over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from hirelake.functions import payload as pay, scalar as fn, scope, text
from hirelake.operators import enrich, lifecycle
from hirelake.operators.joins import many_rows
from hirelake.plans import daily
from hirelake.plans.job_queries import _DECIDED_SQL, _DUE, _EXPIRY, _OUT, _WORKABLE
from hirelake.plans.registry import query
from hirelake.plans.standins import ORDERS_AS_OF, cte, plain, standin, table
from hirelake.session import cut_lineage
from hirelake.sources import payloads as src


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# --- descriptions -----------------------------------------------------------

# Documents with section headings and legal lines worked into the whole text.
_POSTING = (
    "'About the role:' || chr(10) || replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || 'What we offer' || chr(10)), "
    "', ', ',' || chr(13) || '  REQUIREMENTS   –  ' || chr(10)), ' on', chr(10) || 'An Equal Opportunity Employer' || chr(10) || ' on') "
    "|| chr(10) || 'About us' || chr(10) || text"
)
_WORDS = "length(regexp_replace(line, '[^\\s]+', 'x', 'g'))"
_LINES_SQL = f"""WITH docs AS (SELECT doc_id, string_split(regexp_replace({_POSTING}, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM docs),
lines AS (SELECT doc_id, pos, regexp_replace(regexp_replace(part, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS line FROM raw),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[:\\-–—]+$', ''), '\\s+', ' ', 'g')) AS key,
    length(line) <= 100 AND NOT regexp_matches(line, '^[-•*]') AND NOT (line LIKE '%.' AND len(string_split(regexp_replace(line, '\\s+', ' ', 'g'), ' ')) > 8) AS heading
  FROM lines WHERE line <> ''),
tagged AS (SELECT *, CASE
    WHEN heading AND ((key LIKE 'about %' AND key NOT IN {_list(text.ROLE_ABOUT_HEADINGS)})
      OR (key NOT LIKE 'about %' AND key IN {_list(text.BOILERPLATE_HEADINGS)})) THEN 'B'
    WHEN heading AND key IN {_list(text.RELEVANT_HEADINGS)} THEN 'R'
    WHEN {" OR ".join("contains(lower(line), '" + p + "')" for p in text.LEGAL_PHRASES)} THEN 'L' ELSE 'N' END AS tag FROM keyed)
"""


def postings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_POSTING).alias("description_text"))


@query("t01_line_tags", _LINES_SQL + "SELECT tag, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM tagged GROUP BY 1")
def t01(spark, sf):
    lines = postings(spark, sf).select(F.explode(text.description_lines("description_text")).alias("line"))
    return (
        lines.groupBy(text.line_tag(F.col("line")).alias("tag"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))
    )


_COMPACT_SQL = (
    _LINES_SQL
    + """, sections AS (SELECT *, last_value(CASE WHEN tag IN ('B', 'R') THEN tag END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM tagged),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS everything,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE tag = 'R' OR (tag = 'N' AND section IS DISTINCT FROM 'B')), '') AS kept FROM sections GROUP BY 1),
compacted AS (SELECT doc_id, CASE WHEN length(kept) < 500 THEN everything ELSE kept END AS t FROM joined)
"""
)


@query("t05_compact_descriptions", _COMPACT_SQL + "SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM compacted")
def t05(spark, sf):
    compact = text.compact_descriptions(postings(spark, sf), "description_text", "t")
    return plain(compact.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest")))


@query(
    "p13_classifier_payload",
    _COMPACT_SQL + "SELECT doc_id AS job_id, d.source AS original_title, d.lang AS company, md5(t) AS digest FROM compacted JOIN documents d USING (doc_id)",
)
def p13(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("title"), F.col("lang").alias("company"), F.expr(_POSTING).alias("description_text")
    )
    payload = enrich.classifier_payload(rows)
    return plain(payload.select("job_id", "original_title", "company", F.md5("description").alias("digest")))


# A sentence put into every document; the SQL tells by hand which are evidence.
_SENTENCES = (
    "CASE doc_id % 9 WHEN 0 THEN 'Must be a U.S. Citizen.' WHEN 1 THEN 'US CITIZENS only' WHEN 2 THEN 'a united states citizen' WHEN 3 THEN 'You MUST be a citizen' "
    "WHEN 4 THEN 'Citizenship required' WHEN 5 THEN 'citizenship is required' WHEN 6 THEN 'U S citizen' WHEN 7 THEN 'must be  a citizen' END"
)


@query(
    "f22_citizenship_evidence",
    """SELECT doc_id, coalesce(doc_id % 9 < 5 OR regexp_matches(text, '(?i)u\\.s\\. citizen|us citizen|united states citizen|must be a citizen|citizenship required'), false)
  AND text IS NOT NULL AND doc_id % 9 <> 8 AS mentioned FROM documents""",
)
def f22(spark, sf):
    edited = F.concat("text", F.lit(" "), F.expr(_SENTENCES))  # NULL where there is no sentence
    return table(spark, sf, "documents").select("doc_id", text.mentions_citizenship(edited).alias("mentioned"))


# Decoding needs a real HTML parser, so this one has no SQL twin; tests compare it with hand-made pages.
# --- scope ------------------------------------------------------------------

_PLACE = (
    "CASE n_chars % 11 WHEN 0 THEN 'Chicago, IL' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Tbilisi, Georgia' WHEN 3 THEN 'Atlanta, GA' "
    "WHEN 4 THEN 'Georgia, USA' WHEN 5 THEN 'Toronto, Canada' WHEN 6 THEN 'Santa Fe, New Mexico' WHEN 7 THEN 'Bengaluru, IN' "
    "WHEN 8 THEN 'London uk' WHEN 9 THEN 'Batumi, GE' END"
)
_OFFICE = "CASE doc_id % 5 WHEN 0 THEN 'Austin, TX 78701' WHEN 1 THEN 'Paris, France' WHEN 2 THEN ' HQ ' WHEN 3 THEN 'Remote' ELSE '' END"
_COUNTRY = "CASE doc_id % 4 WHEN 0 THEN '\"US\"' WHEN 1 THEN '{\"code\": \"DE\", \"name\": \"Germany\"}' WHEN 2 THEN '\"Atlantis\"' ELSE 'null' END"
_PAYLOAD = (
    "CASE lang WHEN 'en' THEN '{\"location\": {\"name\": \"' || p || '\"}, \"departments\": [{\"name\": \" Eng \"}, {\"name\": \"Eng\"}], "
    "\"offices\": [{\"name\": \"HQ\", \"location\": \"' || o || '\"}, {\"name\": \"' || o || '\"}]}' "
    "WHEN 'fr' THEN '{\"location\": \"' || p || '\", \"department\": \"Data\", \"team\": \"Core\", \"address\": {\"postalAddress\": {\"addressLocality\": \"Town\", \"addressCountry\": ' || c || '}}, "
    "\"secondaryLocations\": [{\"location\": \"' || o || '\", \"address\": {\"addressRegion\": \"North\"}}]}' "
    "WHEN 'de' THEN '{\"categories\": {\"location\": \"' || p || '\", \"team\": \"Ops\", \"allLocations\": [\"' || o || '\", \"' || p || '\"]}}' END"
)
_DESCRIPTION = (
    "CASE doc_id % 3 WHEN 0 THEN text || ' Remote within the United States.' WHEN 1 THEN text || ' Only in Canada' ELSE text END"
)


def scope_rows(spark, sf):
    staged = table(spark, sf, "documents").selectExpr("*", f"{_PLACE} AS place", f"{_OFFICE} AS o", f"{_COUNTRY} AS c").selectExpr("*", "coalesce(place, 'Anywhere') AS p")
    return staged.selectExpr(
        "doc_id", "CASE lang WHEN 'en' THEN ' Greenhouse' WHEN 'fr' THEN 'ashby' WHEN 'de' THEN 'lever' ELSE 'gem' END AS provider",
        "place AS location", f"{_PAYLOAD} AS raw_payload", f"{_DESCRIPTION} AS description_text", "source", "lang",
    )


_SCOPE_SQL = f"""WITH base AS (SELECT *, {_PLACE} AS place, {_OFFICE} AS o, {_COUNTRY} AS c, {_DESCRIPTION} AS description FROM documents),
d AS (SELECT *, coalesce(place, 'Anywhere') AS p FROM base)
"""


def _found(x: str, pattern: str) -> str:
    # Word boundaries spelled out, because RE2's \b only knows ASCII letters.
    parts = [r"(?:^|[^\p{L}\p{N}_])" + p[2:] if p.startswith(r"\b") else p for p in pattern.split("|")]
    quoted = "|".join(parts).replace(r"\b", r"(?:$|[^\p{L}\p{N}_])").replace("'", "''")
    return f"coalesce(regexp_matches(lower(trim({x})), '{quoted}'), FALSE)"


def _us(x: str) -> str:
    return "(" + " OR ".join(_found(x, p) for p in (scope.US_COUNTRY_PATTERN, scope.STATE_NAME_PATTERN, scope.STATE_CODE_PATTERN)) + ")"


def _other(x: str) -> str:
    return f"({_found(x, scope.OTHER_COUNTRY_PATTERN)} AND NOT {_found(x, scope.US_COUNTRY_PATTERN)})"


_SCOPE_REASON = f"""CASE WHEN lang = 'fr' AND doc_id % 4 = 0 THEN 'ashby_country_us'
  WHEN lang = 'fr' AND doc_id % 4 = 1 THEN 'structured_country_non_us'
  WHEN {_other('place')} THEN 'primary_location_non_us' WHEN {_us('place')} THEN 'primary_location_us'
  WHEN lang IN ('en', 'fr', 'de') AND ({_us('p')} OR {_us('o')}) THEN 'structured_location_us'
  WHEN lang IN ('en', 'fr', 'de') AND ({_other('p')} OR {_other('o')}) THEN 'structured_location_non_us'
  WHEN {_found('description', scope.US_COUNTRY_PATTERN)} THEN 'description_country_us'
  WHEN {_other('description')} THEN 'description_country_non_us' ELSE 'no_clear_us_evidence' END"""


@query(
    "c01_market_scope",
    _SCOPE_SQL
    + f"""SELECT doc_id, reason AS us_scope_reason, CASE WHEN reason LIKE '%\\_non\\_us' ESCAPE '\\' THEN 'non_us'
  WHEN reason LIKE '%\\_us' ESCAPE '\\' THEN 'us' ELSE 'unknown' END AS us_scope FROM (SELECT doc_id, {_SCOPE_REASON} AS reason FROM d)""",
)
def c01(spark, sf):
    return scope.classify_scope(scope_rows(spark, sf)).select("doc_id", "us_scope", "us_scope_reason")


@query(
    "c01_text_evidence",
    f"""SELECT doc_id, {_found('text', scope.US_COUNTRY_PATTERN)} AS names_us, {_other('text')} AS names_other_country,
  {_found('text', scope.STATE_NAME_PATTERN)} AS names_us_state, {_found('text', scope.STATE_CODE_PATTERN)} AS has_state_code FROM documents""",
)
def c01_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        scope.names_us("text").alias("names_us"),
        scope.names_other_country("text").alias("names_other_country"),
        scope.names_us_state("text").alias("names_us_state"),
        scope.has_us_state_code("text").alias("has_state_code"),
    )


# --- structured context and hash --------------------------------------------

_CONTEXT_SQL = (
    _SCOPE_SQL
    + """, listed AS (SELECT *, nullif(trim(o), '') AS ot,
  CASE WHEN c LIKE '"%' THEN 'Town, ' || replace(c, '"', '') WHEN c = 'null' THEN 'Town' ELSE 'Town, ' || replace(c, ': ', ':') END AS address FROM d),
context AS (SELECT *,
  CASE lang WHEN 'en' THEN ['Eng'] WHEN 'fr' THEN ['Data'] ELSE [] END AS departments,
  CASE lang WHEN 'fr' THEN ['Core'] WHEN 'de' THEN ['Ops'] ELSE [] END AS teams,
  CASE lang WHEN 'en' THEN CASE WHEN ot IS NULL OR ot = p THEN [p] ELSE [p, ot] END
    WHEN 'fr' THEN CASE WHEN ot IS NULL THEN [p, address, 'North'] WHEN ot = p THEN [p, address, 'North'] ELSE [p, address, ot, 'North'] END
    WHEN 'de' THEN CASE WHEN ot IS NULL OR ot = p THEN [p] ELSE [p, ot] END ELSE [] END AS locations,
  CASE lang WHEN 'en' THEN CASE WHEN ot IS NULL OR ot = 'HQ' THEN ['HQ'] ELSE ['HQ', ot] END ELSE [] END AS offices FROM listed)
"""
)


@query(
    "p08_structured_context",
    _CONTEXT_SQL
    + """SELECT doc_id, array_to_string(departments, '|') AS departments, array_to_string(teams, '|') AS teams,
  replace(replace(array_to_string(locations, '|'), ': ', ':'), ', "', ',"') AS locations, array_to_string(offices, '|') AS offices FROM context""",
)
def p08(spark, sf):
    rows = enrich.deterministic_fields(scope_rows(spark, sf).withColumn("external_job_id", F.col("doc_id")))
    context = F.col("structured_context")
    # An object-valued country is given as JSON, whose spacing differs between engines.
    places = F.replace(F.array_join(context["locations"], "|"), F.lit(": "), F.lit(":"))
    places = F.replace(places, F.lit(', "'), F.lit(',"'))
    return plain(
        rows.select(
            "doc_id", context["departments"].alias("departments"), context["teams"].alias("teams"),
            places.alias("locations"), context["offices"].alias("offices"),
        )
    )


@query(
    "x10_content_hash",
    """SELECT doc_id, sha256(CAST(to_json(struct_pack(company := lang, description := text, employment_type := CAST(NULL AS VARCHAR), location := source,
  structured_context := struct_pack(departments := CAST([] AS VARCHAR[]), teams := ['Ops'], locations := [source], offices := CAST([] AS VARCHAR[])),
  title := source, workplace_type := lang)) AS VARCHAR)) AS content_hash FROM documents""",
)
def x10(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.lit("lever").alias("provider"),
        F.col("source").alias("title"),
        F.col("lang").alias("company"),
        F.col("source").alias("location"),
        F.lit(None).cast("string").alias("employment_type"),
        F.col("lang").alias("workplace_type"),
        F.col("text").alias("description_text"),
        F.to_json(F.struct(F.struct(F.col("source").alias("location"), F.lit("Ops").alias("team")).alias("categories"))).alias("raw_payload"),
    )
    return src.with_content_hash(rows).select("doc_id", "content_hash")


# --- board responses --------------------------------------------------------

_PROVIDER = "CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' ELSE 'lever' END"
_JOB = {
    "greenhouse": "'{\"id\": ' || {id} || ', \"title\": \"Engineer ' || c_nationkey || '\", \"company_name\": \"' || c_name || '\", \"location\": {\"name\": \"Chicago, IL\"}, "
    "\"first_published\": \"2026-09-29T14:00:00Z\", \"content\": \"&lt;p&gt;Build &amp;amp; run ' || {id} || '.&lt;/p&gt;&lt;p&gt; Now &lt;/p&gt;\", \"absolute_url\": \"https://x.test/' || {id} || '\"}'",
    "ashby": "'{\"id\": \"a' || {id} || '\", \"title\": \"Analyst\", \"location\": \"New York, NY\", \"employmentType\": \"FullTime\", \"workplaceType\": \"Hybrid\", "
    "\"publishedAt\": \"2026-09-29T15:00:00.000+02:00\", \"descriptionHtml\": \"<p>Data</p>\", \"descriptionPlain\": \"Data\", \"jobUrl\": \"https://x.test/' || {id} || '\", \"applyUrl\": \"https://x.test/apply\"}'",
    "lever": "'{\"id\": \"l' || {id} || '\", \"text\": \"Manager\", \"categories\": {\"location\": \"Austin, TX\", \"commitment\": \"Full-time\"}, \"workplaceType\": \"hybrid\", "
    "\"description\": \"<p>Help</p>\", \"descriptionPlain\": \"Help\", \"hostedUrl\": \"https://x.test/' || {id} || '\"}'",
}


def _jobs(provider: str) -> str:
    one, two = (_JOB[provider].replace("{id}", f"CAST({e} AS STRING)") for e in ("c_custkey", "(c_custkey + 1000000)"))
    listed = f"CASE WHEN c_acctbal < 2000 THEN '[]' ELSE '[' || {one} || ', ' || {two} || ']' END"
    return listed if provider == "lever" else f"'{{\"jobs\": ' || {listed} || '}}'"


_BOARDS = {
    "source_id": "c_custkey",
    "crawl_run_id": "c_custkey + 7",
    "provider": _PROVIDER,
    "board": "'board-' || CAST(c_custkey AS STRING)",
    "body": "CASE WHEN c_acctbal > 9000 THEN '{\"jobs\": {}}' WHEN c_acctbal > 8000 THEN '{}' WHEN c_acctbal > 7500 AND c_mktsegment <> 'BUILDING' "
    f"THEN 'not json' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN {_jobs('greenhouse')} WHEN 'MACHINERY' THEN {_jobs('ashby')} ELSE {_jobs('lever')} END END",
}


def boards(spark, sf, body=_BOARDS["body"]):
    columns = _BOARDS | {"body": body}
    return table(spark, sf, "customer").selectExpr(*[f"{e.replace('c_nationkey', 'CAST(c_nationkey AS STRING)')} AS {c}" for c, e in columns.items()])


_BAD = "(c_acctbal > 8000 OR (c_acctbal > 7500 AND c_mktsegment <> 'BUILDING'))"


@query(
    "s04_quarantined_boards",
    f"""SELECT c_custkey AS source_id, {_PROVIDER} AS provider, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
  THEN 'response must be an object with a list of jobs' ELSE 'response must be a list' END AS error FROM customer WHERE {_BAD}""",
)
def s04(spark, sf):
    return src.split_boards(boards(spark, sf))[1].select("source_id", "provider", "error")


@query(
    "l01_daily_crawl",
    f"""SELECT c_custkey AS source_id, CASE WHEN {_BAD} THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN {_BAD} THEN NULL WHEN c_acctbal < 2000 THEN 0 ELSE 2 END AS job_count,
  CASE WHEN {_BAD} THEN CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'response must be an object with a list of jobs' ELSE 'response must be a list' END END AS error,
  CASE WHEN {_BAD} OR c_acctbal < 2000 THEN 0 ELSE 2 END AS created,
  CASE WHEN {_BAD} OR c_acctbal < 2000 OR {_PROVIDER} = 'lever' THEN 0 ELSE 2 END AS queued,
  NOT {_BAD} AND c_acctbal >= 2000 AS has_company FROM customer""",
)
def l01_daily(spark, sf):
    """A whole first crawl: every board's response to jobs, events, queue rows, companies and crawl runs."""
    out = first_crawl(spark, sf)
    jobs = many_rows(out.result.jobs.select("job_id", "source_id"))
    events = out.result.events.where("event_type = 'created'").join(jobs, "job_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("created"))
    queued = out.result.queue.join(jobs, "job_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("queued"))
    linked = out.result.sources.select("source_id", F.col("company_id").isNotNull().alias("has_company"))
    rows = out.result.crawl_runs.join(events, "source_id", "left").join(queued, "source_id", "left").join(linked, "source_id")
    return plain(
        rows.fillna(0, ["created", "queued"]).select("source_id", "status", "job_count", "error", "created", "queued", "has_company")
    )


def first_crawl(spark, sf):
    responses = boards(spark, sf)

    def none(schema: str):
        return spark.createDataFrame([], schema)

    fields = [c.split() for c in lifecycle.SOURCE_SCHEMA.split(", ")]
    known = responses.select("source_id", F.lit("active").alias("status"))
    sources = known.select(*[(F.col(c) if c in known.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])
    now = "2026-09-30 12:00:00"
    crawls = responses.select("source_id", "crawl_run_id", F.lit(now).cast("timestamp").alias("started_at"))
    companies = none("company_id string, name string, normalized_name string, slug string, website_domain string, tracking_started_at timestamp")
    return daily.crawl(responses, crawls, none(lifecycle.JOB_SCHEMA), sources, companies, none(lifecycle.QUEUE_SCHEMA), now, cut=cut_lineage)


def _next_jobs(provider: str) -> str:
    """The second response: as before, one gone, one moved, none, no JSON, one without a title, one more, two others."""
    one, two, three, four = (_JOB[provider].replace("{id}", f"CAST((c_custkey + {n}000000) AS STRING)") for n in range(4))
    one = one.replace("c_custkey + 0000000", "c_custkey")
    moved = f"replace(replace(replace({one}, 'Chicago, IL', 'Boston, MA'), 'New York, NY', 'Boston, MA'), 'Austin, TX', 'Boston, MA')"
    untitled = f"""replace(replace({two}, '"title"', '"name"'), '"text"', '"name"')"""
    lists = {0: [one, two], 1: [one], 2: [moved, two], 3: [], 5: [one, untitled], 6: [one, two, three], 7: [three, four]}
    joined = {k: " || ', ' || ".join(v) or "''" for k, v in lists.items()}
    listed = "CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN '[' || {v} || ']'" for k, v in joined.items()) + " END"
    whole = listed if provider == "lever" else f"'{{\"jobs\": ' || {listed} || '}}'"
    return f"coalesce({whole}, 'not json')"


_NEXT_BODY = (
    f"CASE c_mktsegment WHEN 'BUILDING' THEN {_next_jobs('greenhouse')} WHEN 'MACHINERY' THEN {_next_jobs('ashby')} ELSE {_next_jobs('lever')} END"
)


@query(
    "l01_second_crawl",
    f"""WITH b AS (SELECT c_custkey AS source_id, c_custkey % 8 AS k, {_PROVIDER} AS provider, {_BAD} AS failed_before,
    CASE WHEN {_BAD} THEN NULL WHEN c_acctbal < 2000 THEN 0 ELSE 2 END AS previous FROM customer),
  c AS (SELECT *, k NOT IN (4, 5) AS ok, coalesce(previous, 0) = 2 AS had, CASE k WHEN 1 THEN 1 WHEN 3 THEN 0 WHEN 6 THEN 3 ELSE 2 END AS n FROM b),
  d AS (SELECT *, CASE WHEN had AND k = 3 THEN 'zero-job anomaly: previous_job_count=2, current_job_count=0'
      WHEN had AND k = 1 THEN 'mass-drop anomaly: previous_job_count=2, current_job_count=1, threshold_ratio=0.75' END AS warning,
    CASE WHEN NOT ok THEN 0 WHEN NOT had THEN n WHEN k = 6 THEN 1 WHEN k = 7 THEN 2 ELSE 0 END AS created,
    CASE WHEN had AND k = 2 THEN 1 ELSE 0 END AS jobs_changed, CASE WHEN had AND k = 7 THEN 2 ELSE 0 END AS jobs_removed FROM c)
SELECT source_id, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN n END AS job_count, warning, warning IS NOT NULL AS deactivation_skipped,
  CASE k WHEN 4 THEN CASE WHEN provider = 'lever' THEN 'response must be a list' ELSE 'response must be an object with a list of jobs' END
    WHEN 5 THEN 'posting 1 has no title' END AS error,
  created, CASE WHEN failed_before THEN 0 ELSE created END AS jobs_new, jobs_changed, jobs_removed, jobs_changed AS versions,
  CASE WHEN provider = 'lever' THEN 0 ELSE created + jobs_changed END AS queued,
  CASE WHEN had THEN CASE k WHEN 6 THEN 3 ELSE 2 END WHEN ok THEN n ELSE 0 END AS active,
  CASE WHEN ok THEN 0 WHEN failed_before THEN 2 ELSE 1 END AS consecutive_failures,
  CASE WHEN ok AND warning IS NULL THEN n ELSE previous END AS last_job_count FROM d""",
)
def l01_second(spark, sf):
    """The crawl after the first, through the whole chain: changes, removals, both anomalies, and sources that fail by themselves."""
    first = first_crawl(spark, sf)
    state, sources, queue = (many_rows(cut_lineage(df)) for df in (first.result.jobs, first.result.sources, first.result.queue))
    responses = boards(spark, sf, _NEXT_BODY).withColumn("crawl_run_id", F.col("crawl_run_id") + 10_000_000)
    now = "2026-09-30 12:30:00"
    crawls = responses.select("source_id", "crawl_run_id", F.lit(now).cast("timestamp").alias("started_at"))
    out = daily.crawl(
        responses, crawls, state, sources, first.companies, queue, now, cut=cut_lineage, min_previous=2, min_ratio=0.75
    ).result
    owner = many_rows(out.jobs.select("job_id", "source_id"))

    def per_source(rows, name):
        return many_rows(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(name)))

    rows = out.crawl_runs.join(many_rows(out.per_source).select("source_id", "jobs_new", "jobs_changed", "jobs_removed"), "source_id")
    for counted in (
        per_source(out.events.where("event_type = 'created'").join(owner, "job_id"), "created"),
        per_source(out.versions.join(owner, "job_id"), "versions"),
        per_source(out.queue.join(owner, "job_id"), "queued"),
        per_source(out.jobs.where("active"), "active"),
    ):
        rows = rows.join(counted, "source_id", "left")
    rows = rows.join(many_rows(out.sources.select("source_id", "consecutive_failures", "last_job_count")), "source_id")
    return plain(rows.fillna(0, ["created", "versions", "queued", "active"]).drop("crawl_run_id", "started_at", "finished_at"))


_POSTED_SQL = f"""WITH b AS (SELECT *, {_PROVIDER} AS provider FROM customer WHERE NOT {_BAD} AND c_acctbal >= 2000),
p AS (SELECT *, 0 AS pos, CAST(c_custkey AS VARCHAR) AS id FROM b UNION ALL SELECT *, 1, CAST(c_custkey + 1000000 AS VARCHAR) FROM b)
SELECT c_custkey AS source_id, CAST(pos AS BIGINT) AS pos, provider,
  CASE provider WHEN 'greenhouse' THEN id WHEN 'ashby' THEN 'a' || id ELSE 'l' || id END AS external_job_id,
  CASE provider WHEN 'greenhouse' THEN c_name ELSE 'board-' || c_custkey END AS company,
  CASE provider WHEN 'greenhouse' THEN 'Engineer ' || c_nationkey WHEN 'ashby' THEN 'Analyst' ELSE 'Manager' END AS title,
  CASE provider WHEN 'greenhouse' THEN 'Chicago, IL' WHEN 'ashby' THEN 'New York, NY' ELSE 'Austin, TX' END AS location,
  CASE provider WHEN 'ashby' THEN 'FullTime' WHEN 'lever' THEN 'Full-time' END AS employment_type,
  CASE provider WHEN 'ashby' THEN 'Hybrid' WHEN 'lever' THEN 'hybrid' END AS workplace_type,
  CASE provider WHEN 'greenhouse' THEN '2026-09-29 14:00:00' WHEN 'ashby' THEN '2026-09-29 13:00:00' END AS posted_at,
  CASE provider WHEN 'greenhouse' THEN 'greenhouse.first_published' WHEN 'ashby' THEN 'ashby.publishedAt' END AS posted_at_source,
  CASE provider WHEN 'greenhouse' THEN 'Build & run ' || id || '.' || chr(10) || 'Now' WHEN 'ashby' THEN 'Data' ELSE 'Help' END AS description_text,
  CASE provider WHEN 'greenhouse' THEN '<p>Build &amp; run ' || id || '.</p><p> Now </p>' WHEN 'ashby' THEN '<p>Data</p>' ELSE '<p>Help</p>' END AS description_html,
  'https://x.test/' || id AS job_url, CASE provider WHEN 'ashby' THEN 'https://x.test/apply' END AS apply_url FROM p"""


@query("p01_normalized_postings", _POSTED_SQL)
def p01(spark, sf):
    good, _ = src.split_boards(boards(spark, sf))
    rows = src.normalize_postings(src.raw_postings(good), hashed=False)
    return plain(rows.drop("raw_payload", "crawl_run_id"))


# --- enrichment records -----------------------------------------------------

# Words of whole documents as skill entries; the requirement follows the word length.
_NEEDS = "CASE length(w) % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END"


def _word_entries():
    needs = F.array(*(F.lit(x) for x in ("required", "preferred", "mentioned")))
    return F.transform(F.split("text", " "), lambda w: F.struct(w.alias("name"), F.get(needs, F.length(w) % 3).alias("requirement")))


_SKILL_WORDS = """WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
tidy AS (SELECT *, trim(regexp_replace(w, '\\s+', ' ', 'g')) AS name FROM words),
named AS (SELECT *, CASE WHEN lower(name) IN ('js', 'javascript') THEN 'JavaScript' WHEN lower(name) IN ('nodejs', 'node.js') THEN 'Node.js'
    WHEN lower(name) IN ('postgres', 'postgresql') THEN 'PostgreSQL' ELSE name END AS canonical FROM tidy),
keyed AS (SELECT *, regexp_replace(lower(upper(KEYED)), '[^\\p{L}\\p{N}]', '', 'g') AS key, CASE length(w) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rank FROM named),
firsts AS (SELECT doc_id, key, min(pos) AS first_pos FROM keyed GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY rank DESC, pos) AS rn FROM keyed) WHERE rn = 1)
SELECT doc_id, count(*) AS n, md5(string_agg(canonical || '/' || rank, '|' ORDER BY first_pos)) AS digest
FROM best JOIN firsts USING (doc_id, key) GROUP BY 1"""


@query("a27_merged_skills", _SKILL_WORDS.replace("KEYED", "canonical"))
def a27(spark, sf):
    merged = table(spark, sf, "documents").select("doc_id", enrich.merge_skills(_word_entries()).alias("s"))
    rank = lambda e: F.when(e["requirement"] == "required", "2").when(e["requirement"] == "preferred", "1").otherwise("0")
    joined = F.array_join(F.transform("s", lambda e: F.concat(e["name"], F.lit("/"), rank(e))), "|")
    return plain(merged.select("doc_id", F.size("s").alias("n"), F.md5(joined).alias("digest")))


# Extracted records from orders; several rules are broken by some of them.
_RECORD = {
    "standardized_title": "'\"Engineer\"'",
    "job_family": "CASE WHEN o_orderstatus = 'O' THEN '\"data\"' ELSE 'null' END",
    "job_subfamily": "'null'",
    "seniority": "CASE WHEN o_totalprice > 480000 THEN '\"boss\"' ELSE '\"senior\"' END",
    "skills": "'[{\"name\": \"JS\", \"requirement\": \"mentioned\"}, {\"name\": \" java  script \", \"requirement\": \"required\"}, {\"name\": \"C++\", \"requirement\": \"preferred\"}, "
    "{\"name\": \"javascript\", \"requirement\": \"preferred\"}, {\"name\": \"' || CASE WHEN o_totalprice < 15000 THEN 'Required' ELSE o_orderpriority END || '\", \"requirement\": \"required\"}]'",
    "domain_tags": "'[\" fin  tech \", \"fin tech\", \"\"]'",
    "years_experience_min": "CAST(o_orderkey % 9 AS STRING)",
    "years_experience_max": "CASE WHEN o_orderstatus = 'F' THEN '6' ELSE 'null' END",
    "education_level": "'\"none\"'",
    "education_fields": "'[]'",
    "certifications": "'[{\"name\": \"PMP\", \"requirement\": \"preferred\"}, {\"name\": \"pmp\", \"requirement\": \"required\"}]'",
    "locations": "CASE WHEN o_orderstatus = 'P' THEN '[{\"city\": \"Austin\", \"state\": null, \"state_code\": null, \"country\": null, \"country_code\": null}]' "
    "WHEN o_totalprice > 470000 THEN '[{\"city\": \"Austin\"}]' ELSE '[]' END",
    "workplace_type": "'\"unknown\"'",
    "employment_type": "'\"unknown\"'",
    "contract_duration": "'null'",
    "salary_min": "CASE WHEN o_totalprice > 450000 THEN '-1' ELSE '90000' END",
    "salary_max": "CASE WHEN o_totalprice < 20000 THEN '80000.5' ELSE '110000' END",
    "salary_currency": "'\"usd\"'",
    "salary_period": "'\"year\"'",
    "visa_sponsorship": "'\"unknown\"'",
    "work_authorization_required": "'true'",
    "citizenship_requirement": "'\"U.S. citizen\"'",
    "security_clearance_required": "'null'",
    "security_clearance_level": "'null'",
    "offices": "'[\"Paris HQ\"]'",
    "confidence": "CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN '1.5' ELSE '0.9' END",
}


def _data() -> str:
    fields = " || ', ' || ".join(f"'\"{k}\": ' || {v}" for k, v in _RECORD.items() if k != "confidence")
    tail = f"CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN '' ELSE ', \"confidence\": ' || {_RECORD['confidence']} END"
    extra = "CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 400000 THEN ', \"extra\": 1' ELSE '' END"
    return f"'{{' || {fields} || {tail} || {extra} || '}}'"


def extracted(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job_id", "o_orderstatus AS content_hash", "'v3' AS schema_version", f"{_data()} AS data",
        "'fast' AS model", "o_custkey AS input_tokens", "'x' AS output_tokens", "o_orderstatus", "o_orderpriority",
    )


_NO_CONFIDENCE = "(o_orderpriority = '1-URGENT' AND o_totalprice > 400000)"
_ERROR_RULES = {
    "missing_keys": _NO_CONFIDENCE,
    "extra_keys": "o_orderpriority = '2-HIGH' AND o_totalprice > 400000",
    "enum_seniority": "o_totalprice > 480000",
    "skills": "o_totalprice < 15000",
    "locations": "o_totalprice > 470000 AND o_orderstatus <> 'P'",
    "salary_bounds": "o_totalprice > 450000",
    "years_range": "o_orderstatus = 'F' AND o_orderkey % 9 > 6",
    "salary_range": "o_totalprice < 20000",
    "confidence": f"{_NO_CONFIDENCE} OR (o_orderpriority = '5-LOW' AND o_totalprice > 400000)",
}
_ERRORS = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _ERROR_RULES.items()) + ")"


@query(
    "l22_rejected_records",
    f"SELECT job_id, errors FROM (SELECT o_orderkey AS job_id, {_ERRORS} AS errors FROM orders) WHERE errors <> ''",
)
def l22(spark, sf):
    return plain(enrich.validate_records(extracted(spark, sf))[1].select("job_id", "errors"))


_VALID = f"FROM orders WHERE {_ERRORS} = ''"


@query(
    "p14_projected_records",
    f"""SELECT o_orderkey AS job_id, 'Engineer' AS standardized_title, CASE WHEN o_orderstatus = 'O' THEN 'data' END AS job_family,
  'java script|C++|' || o_orderpriority AS skills, 'java script|' || o_orderpriority AS required_skills, 'C++' AS preferred_skills, CAST(3 AS BIGINT) AS skill_count,
  'pmp' AS certifications, 'fin tech' AS domain_tags, CASE WHEN o_orderstatus = 'P' THEN 'Austin' END AS city, CAST(o_orderkey % 9 AS BIGINT) AS years_experience_min,
  o_custkey AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, left(sha256(o_orderkey || chr(31) || o_orderstatus || chr(31) || 'v3'), 32) AS enrichment_id {_VALID}""",
)
def p14(spark, sf):
    rows = enrich.enrichment_rows(enrich.validate_records(extracted(spark, sf))[0], ORDERS_AS_OF)
    return plain(
        rows.select(
            "job_id", "standardized_title", "job_family", "skills", "required_skills", "preferred_skills", "skill_count",
            "certifications", "domain_tags", "city", "years_experience_min", "input_tokens", "output_tokens", "enrichment_id",
        )
    )


@query(
    "p16_legacy_projection",
    f"""SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'data' END AS job_family, CAST(NULL AS VARCHAR) AS job_subfamily, '' AS related_roles,
  'java script|C++|' || o_orderpriority AS skills, 'senior' AS seniority, CAST(o_orderkey % 9 AS DOUBLE) AS years_experience_min,
  CASE o_orderstatus WHEN 'F' THEN CAST(6 AS DOUBLE) END AS years_experience_max,
  CASE WHEN o_orderstatus = 'P' THEN 'Austin/-/-/-/-/false' ELSE '' END AS ai_locations, CAST(0.9 AS DOUBLE) AS classification_confidence {_VALID}""",
)
def p16(spark, sf):
    valid, _ = enrich.validate_records(extracted(spark, sf))
    legacy = valid.select("job_id", *[v.alias(c) for c, v in enrich.project_legacy(F.col("record")).items()])
    fields = ("city", "state", "state_code", "country", "country_code", "remote")
    places = F.transform("ai_locations", lambda x: F.concat_ws("/", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]))
    years = {c: F.col(c).cast("double") for c in ("years_experience_min", "years_experience_max")}
    return plain(legacy.withColumns({"ai_locations": places, **years}))


@query(
    "u06_record_keys",
    f"""SELECT o_orderkey AS job_id, CASE WHEN {_NO_CONFIDENCE} THEN 'confidence' ELSE '' END AS missing,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 400000 THEN 'extra' ELSE '' END AS extra FROM orders""",
)
def u06(spark, sf):
    found = enrich.key_differences(F.col("data"))
    return plain(extracted(spark, sf).select("job_id", found.alias("k")).select("job_id", "k.missing", "k.extra"))


# Provider facts of the same orders.
_FACTS = {
    "job_id": "o_orderkey",
    "provider": "CASE o_orderstatus WHEN 'O' THEN 'greenhouse' WHEN 'F' THEN 'Ashby' ELSE 'lever' END",
    "location": "CASE WHEN o_orderpriority = '5-LOW' THEN 'Remote' ELSE 'Austin' END",
    "employment_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Full-Time' WHEN o_orderpriority = '2-HIGH' THEN 'gig' END",
    "workplace_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'In Office' END",
    "raw_payload": "CASE o_orderstatus WHEN 'O' THEN '{\"offices\": [{\"name\": \"Paris HQ\", \"location\": \"Paris, France\"}, {\"name\": \"Lyon\"}], "
    "\"compensation\": {\"min\": \"high\", \"minimum\": 1, \"max\": 120000, \"currency\": \"eur\", \"interval\": \"yearly\"}}' "
    "WHEN 'F' THEN '{\"address\": {\"postalAddress\": {\"addressLocality\": \"Berlin\", \"addressCountry\": \"USA\"}}, \"secondaryLocations\": [{\"location\": \"Oslo\"}], \"salaryRange\": {\"minValue\": 5, \"maxValue\": true, \"unit\": \"Hourly\"}}' "
    "ELSE '{\"categories\": {\"location\": \"Austin\", \"allLocations\": [\"Dallas\", \"remote\"]}}' END",
    "description_text": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Must be a Citizen.' ELSE 'Open to all' END",
}


@query(
    "l21_trusted_facts",
    f"""SELECT o_orderkey AS job_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'full_time' ELSE 'unknown' END AS employment_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'onsite' ELSE 'unknown' END AS workplace_type,
  CASE o_orderstatus WHEN 'O' THEN CAST(90000 AS DOUBLE) WHEN 'F' THEN CAST(5 AS DOUBLE) ELSE CAST(90000 AS DOUBLE) END AS salary_min,
  CASE o_orderstatus WHEN 'O' THEN CAST(120000 AS DOUBLE) ELSE CAST(110000 AS DOUBLE) END AS salary_max,
  CASE o_orderstatus WHEN 'O' THEN 'EUR' ELSE 'usd' END AS salary_currency, CASE o_orderstatus WHEN 'F' THEN 'hour' ELSE 'year' END AS salary_period,
  CASE o_orderstatus WHEN 'O' THEN 'Paris HQ|Lyon' ELSE 'Paris HQ' END AS offices,
  CASE o_orderstatus WHEN 'O' THEN 'Paris, France' WHEN 'F' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'Berlin' ELSE 'Austin' END || '|Oslo|Berlin, USA' ELSE 'Austin|Dallas' END AS cities,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'U.S. citizen' END AS citizenship_requirement {_VALID}""",
)
def l21(spark, sf):
    facts = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _FACTS.items()])
    valid, _ = enrich.validate_records(extracted(spark, sf).select("job_id", "data"))
    merged = enrich.merge_trusted_facts(valid.join(facts, "job_id"))
    cities = F.transform(F.col("record.locations"), lambda x: x["city"]).alias("cities")
    names = ("employment_type", "workplace_type", "salary_min", "salary_max", "salary_currency", "salary_period", "offices", "citizenship_requirement")
    return plain(merged.select("job_id", *[F.col(f"record.{n}").alias(n) for n in names], cities))


@query(
    "l20_upserted_enrichments",
    cte("enrichments")
    + f""", fresh AS (SELECT CAST(o_orderkey AS BIGINT) AS job_id, o_orderstatus AS content_hash, 'v3' AS schema_version {_VALID}),
stored AS (SELECT job_id, content_hash, schema_version, max(standardized_title) AS standardized_title FROM enrichments GROUP BY 1, 2, 3)
SELECT coalesce(s.job_id, f.job_id) AS job_id, coalesce(s.content_hash, f.content_hash) AS content_hash,
  coalesce(s.schema_version, f.schema_version) AS schema_version, CASE WHEN f.job_id IS NOT NULL THEN 'Engineer' ELSE s.standardized_title END AS standardized_title
FROM stored s FULL JOIN fresh f ON f.job_id = s.job_id AND f.content_hash = s.content_hash AND f.schema_version = s.schema_version""",
)
def l20(spark, sf):
    stored = standin(spark, sf, "enrichments").groupBy("job_id", "content_hash", "schema_version").agg(
        F.max("standardized_title").alias("standardized_title")
    )
    rows = enrich.enrichment_rows(enrich.validate_records(extracted(spark, sf))[0], ORDERS_AS_OF)
    return enrich.upsert_enrichments(stored, rows)


@query(
    "s11_current_and_stale_results",
    cte("order_jobs")
    + """SELECT count(*) FILTER (WHERE j.job_id IS NOT NULL) AS current, count(*) FILTER (WHERE j.job_id IS NULL) AS stale
FROM (SELECT l_orderkey AS job_id, l_returnflag AS content_hash FROM lineitem) r LEFT JOIN order_jobs j USING (job_id, content_hash)""",
)
def s11(spark, sf):
    results = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "l_returnflag AS content_hash")
    current, stale = enrich.current_results(results, standin(spark, sf, "order_jobs"))
    tagged = current.select(F.lit(1).alias("c")).unionByName(stale.select(F.lit(0).alias("c")))
    return tagged.agg(F.count(F.when(F.col("c") == 1, 1)).alias("current"), F.count(F.when(F.col("c") == 0, 1)).alias("stale"))


# --- promotion of stored JSON and version-2 records -------------------------

_STORED = (
    "'{\"standardized_title\": \"' || CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END || '\", \"required_skills\": [\"SQL\", \"' || o_orderstatus || '\"], "
    "\"preferred_skills\": ' || CASE WHEN o_orderstatus = 'F' THEN '{\"a\": 1}' ELSE '[\"Python\"]' END || ', \"years_experience_min\": ' || CASE o_orderstatus WHEN 'P' THEN '\"3+\"' ELSE '3' END || "
    "', \"salary_min\": \"' || CASE o_orderstatus WHEN 'P' THEN '-5' ELSE '1000.5' END || '\", \"relocation_available\": ' || CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN '\"False\"' ELSE '\"maybe\"' END || "
    "', \"locations\": [{\"city\": \"Austin\", \"region\": \"Texas\"}], \"required_certifications\": [\"PMP\"]}'"
)


@query(
    "p17_promoted_json",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS standardized_title,
  'SQL|' || o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '|Python' END AS skills, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END AS BIGINT) AS skill_count,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(3 AS DOUBLE) END AS years_experience_min, CASE WHEN o_orderstatus <> 'P' THEN CAST(1000.5 AS DOUBLE) END AS salary_min,
  CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS relocation_available, 'Austin' AS city, 'Texas' AS state, 'PMP' AS certifications FROM orders""",
)
def p17(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", f"{_STORED} AS data")
    columns = enrich.promote_json(F.col("data"))
    promoted = rows.select("job_id", *[columns[c].alias(c) for c in (
        "standardized_title", "skills", "skill_count", "years_experience_min", "salary_min", "relocation_available", "city", "state", "certifications")])
    return plain(promoted.withColumn("years_experience_min", F.col("years_experience_min").cast("double")))


@query(
    "p15_version_2_lists",
    """SELECT l_orderkey AS job_id, l_linenumber + 0 AS line, array_to_string(list_distinct_in_order, '|') AS skills, CAST(len(list_distinct_in_order) AS BIGINT) AS skill_count FROM (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN ['Skill ' || l_returnflag, 'Team work'] ELSE ['Skill ' || l_returnflag, 'Skill ' || l_linestatus, 'Team work'] END AS list_distinct_in_order FROM lineitem)""",
)
def p15(spark, sf):
    empty = F.array().cast("array<string>")
    record = F.struct(
        F.array(F.concat(F.lit(" Skill  "), F.col("l_returnflag"))).alias("required_skills"),
        F.array(F.concat(F.lit("Skill "), F.col("l_linestatus")), F.lit(" ")).alias("preferred_skills"),
        F.array(F.lit("Team\t work")).alias("soft_skills"),
        empty.alias("required_certifications"),
        empty.alias("preferred_certifications"),
        F.from_json(F.lit("[]"), f"array<{enrich.LOCATION}>").alias("locations"),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", record.alias("record"))
    columns = enrich.project_v2(F.col("record"))
    return plain(
        rows.select(
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), columns["skills"].alias("skills"),
            columns["skill_count"].alias("skill_count"),
        )
    )


@query(
    "c07_type_normalisers",
    cte("jobs")
    + """SELECT job_id, CASE employment_type WHEN 'FullTime' THEN 'full_time' WHEN 'part-time' THEN 'part_time' WHEN 'Intern' THEN 'internship' END AS employment_type,
  CASE workplace_type WHEN 'On Location' THEN 'onsite' WHEN 'Hybrid' THEN 'hybrid' WHEN 'REMOTE' THEN 'remote' END AS workplace_type,
  CASE k WHEN 1 THEN 'year' WHEN 2 THEN 'hour' END AS salary_period, CASE WHEN location <> 'Remote' THEN location END AS place,
  CASE WHEN k = 3 THEN 'US' END AS country_code FROM jobs""",
)
def c07(spark, sf):
    k = F.col("k")
    return standin(spark, sf, "jobs").select(
        "job_id",
        fn.employment_type("employment_type").alias("employment_type"),
        fn.workplace_type("workplace_type").alias("workplace_type"),
        fn.salary_period(F.when(k == 1, " Annu_ally").when(k == 2, "Hourly").otherwise("fortnight")).alias("salary_period"),
        fn.place_label("location").alias("place"),
        fn.us_country_code(F.when(k == 3, " U.S. ").otherwise("Canada")).alias("country_code"),
    )


@query(
    "x11_salary_facts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS salary_min, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice + 1 END AS salary_max,
  CASE o_orderstatus WHEN 'O' THEN 'USD' END AS salary_currency, CASE o_orderstatus WHEN 'O' THEN 'year' END AS salary_period FROM orders""",
)
def x11(spark, sf):
    price = F.col("o_totalprice")
    o = F.to_json(F.struct(price.alias("min"), (price + 1).alias("max"), F.lit("usd").alias("currency"), F.lit("Yearly").alias("period")))
    f = F.to_json(F.struct(price.cast("string").alias("minimum"), price.alias("minAmount"), (price + 1).alias("upperBound"), F.lit("").alias("currencyCode")))
    salary = F.when(F.col("o_orderstatus") == "O", o).when(F.col("o_orderstatus") == "F", f).otherwise("[1, 2]")
    facts = pay.salary_facts(salary, fn.salary_period)
    return table(spark, sf, "orders").select("o_orderkey", facts.alias("s")).select("o_orderkey", "s.*")


@query(
    "x22_retry_delays",
    """SELECT o_orderkey, CAST(least(3600, greatest(30 * pow(2, greatest(o_orderkey % 12 - 1, 0)), coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100 END, 0))) AS DOUBLE) AS seconds,
  greatest(0, CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS BIGINT) WHEN o_orderstatus = 'F' THEN -o_custkey ELSE 0 END) AS tokens FROM orders""",
)
def x22(spark, sf):
    asked = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 100)
    given = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("-"), F.col("o_custkey").cast("string"))
    ).otherwise("12.5 tokens")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        fn.retry_delay_seconds(F.col("o_orderkey") % 12, asked).alias("seconds"),
        fn.nonnegative_int(given).alias("tokens"),
    )


# One enrichment run: expiry, a budget of 100, records that are valid, rejected, failed or not there.
_RUN_SQL = (
    _DECIDED_SQL
    + f""", ready AS (SELECT q.*, row_number() OVER (ORDER BY priority, created_at, queue_id) AS turn FROM reasons q
  WHERE {_DUE} AND queue_id IN (SELECT q2.queue_id FROM queue q2 JOIN order_jobs j ON j.job_id = q2.job_id AND j.content_hash = q2.content_hash WHERE {_WORKABLE})),
cut AS (SELECT max(turn) AS last, count(*) AS used FROM (SELECT turn FROM ready WHERE first = 'apply' ORDER BY turn LIMIT 100)),
checked AS (SELECT CAST(o_orderkey AS VARCHAR) AS r_id, o_orderkey % 5 = 0 AS lost, replace({_ERRORS}, '|', ', ') AS wrong FROM orders WHERE o_orderkey % 11 <> 0),
batch AS (SELECT ready.*, attempts + 1 AS tried, lost, wrong, CASE WHEN first <> 'apply' OR r_id IS NULL THEN first WHEN NOT lost AND wrong = '' THEN 'completed' ELSE 'failed' END AS outcome
  FROM ready CROSS JOIN cut LEFT JOIN checked ON r_id = queue_id WHERE used < 100 OR turn <= last),
ends AS (SELECT *, outcome IN ('failed', 'deferred_scope') AS retried,
  tried >= 5 OR (outcome = 'failed' AND NOT (lost AND CAST(queue_id AS BIGINT) % 2 = 0)) AS terminal FROM batch)
"""
)


@query(
    "l20_enrich_run",
    _RUN_SQL
    + f"""SELECT q.queue_id, CASE WHEN e.queue_id IS NULL AND hit THEN 'not_eligible' WHEN e.queue_id IS NULL THEN q.status
    WHEN outcome IN ('stale', 'completed') THEN 'completed' WHEN outcome IN ('not_eligible', 'skipped_non_us') THEN 'not_eligible'
    WHEN retried AND terminal THEN 'failed' WHEN retried THEN 'pending' ELSE 'processing' END AS status,
  CAST(coalesce(tried, q.attempts) AS BIGINT) AS attempts,
  CASE WHEN e.queue_id IS NULL AND hit THEN expiry WHEN e.queue_id IS NULL THEN q.last_error
    WHEN outcome = 'failed' THEN CASE WHEN lost THEN 'no answer' ELSE wrong END
    WHEN outcome IN ('stale', 'not_eligible', 'deferred_scope') THEN outcome_reason END AS last_error
FROM (SELECT q.*, {_EXPIRY} AS expiry, j.job_id IS NOT NULL AND q.status IN ('pending', 'processing') AND {_OUT} AS hit
  FROM queue q LEFT JOIN order_jobs j USING (job_id)) q LEFT JOIN ends e USING (queue_id)""",
)
def l20_run(spark, sf):
    return plain(enrichment_run(spark, sf).queue.select("queue_id", "status", "attempts", "last_error"))


@query("l20_run_records", _RUN_SQL + "SELECT job_id, content_hash, 'Engineer' AS standardized_title FROM ends WHERE outcome = 'completed'")
def l20_records(spark, sf):
    return plain(enrichment_run(spark, sf).enrichments.select("job_id", "content_hash", "standardized_title"))


def enrichment_run(spark, sf):
    lost = F.col("job_id") % 5 == 0
    answers = extracted(spark, sf).where("job_id % 11 <> 0").select(
        F.col("job_id").cast("string").alias("queue_id"),
        F.when(~lost, F.col("data")).alias("data"),
        F.when(lost, "no answer").alias("error"),
        F.when(lost, "Timeout").alias("error_class"),
        F.when(lost, F.col("job_id") % 2 == 0).alias("retryable"),
        F.lit(None).cast("double").alias("retry_after_seconds"),
        "model", "input_tokens", "output_tokens",
    )
    none = enrich.enrichment_rows(enrich.validate_records(extracted(spark, sf))[0], ORDERS_AS_OF).limit(0)
    return daily.enrich_run(standin(spark, sf, "queue"), standin(spark, sf, "order_jobs"), answers, none, ORDERS_AS_OF, 100, cut=cut_lineage)
