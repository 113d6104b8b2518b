"""Canonical current-job view, publication gate and job list projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import (
    age_bucket,
    comma_label,
    days_active,
    decode_percent,
    freshness_hours,
    freshness_source,
    instant,
)

# Columns the current enrichment contributes under their own name.
ENRICHMENT_COLUMNS = (
    "standardized_title", "job_family", "job_subfamily", "related_roles", "role_track", "seniority",
    "leadership_level", "role_keywords", "responsibility_tags", "skills", "required_skills", "preferred_skills",
    "soft_skills", "years_experience_min", "years_experience_max", "education_required", "education_preferred",
    "education_level", "education_fields", "certifications", "locations", "preferred_locations", "city", "state",
    "state_code", "country", "country_code", "relocation_available", "salary_min", "salary_max", "salary_currency",
    "salary_period", "visa_sponsorship", "work_authorization_required", "citizenship_requirement",
    "security_clearance_required", "security_clearance_level",
)
JOB_COLUMNS = (
    "external_job_id", "source_id", "company_id", "provider", "job_url", "apply_url", "posted_at",
    "posted_at_source", "first_seen_at", "last_seen_at", "removed_at", "active", "observed_new_after",
    "observed_new_before", "location", "description_text", "description_html",
)


def public_jobs(jobs: DataFrame, as_of=None, max_age_hours: int | None = None, require_us: bool = True) -> DataFrame:
    """Publication gate; the older gates limited the age or did not require the US."""
    rows = jobs.filter(
        F.col("active")
        & (F.col("classification_status") == "ready")
        & (F.col("classified_content_hash") == F.col("content_hash"))
    )
    if require_us:
        rows = rows.filter("is_us_job")
    if max_age_hours is not None:
        rows = rows.filter(F.col("posted_at") >= instant(as_of) - F.expr(f"INTERVAL '{max_age_hours}' HOUR"))
    return rows


def winners(jobs: DataFrame, enrichments: DataFrame, schema_version: str = "v3", more: tuple[str, ...] = ()) -> DataFrame:
    """Per job: time, number and ``more`` of the latest record of the current content, as
    ``_winner``, and the salary range of other contents."""
    current = F.col("content_hash") == F.col("_job_hash")
    usable = current & (F.col("schema_version") == schema_version)
    salary = F.struct("salary_min", "salary_max")
    newest = F.when(usable, F.struct("created_at", "enrichment_id", *more))
    return (
        enrichments.join(jobs.select("job_id", F.col("content_hash").alias("_job_hash")), "job_id")
        .groupBy("job_id")
        .agg(
            F.max(newest).alias("_winner"),
            F.min(F.when(~current, salary)).alias("_lowest_salary"),
            F.max(F.when(~current, salary)).alias("_highest_salary"),
        )
    )


def won_records(facts: DataFrame, enrichments: DataFrame, schema_version: str = "v3", more: tuple[str, ...] = ()) -> DataFrame:
    """The ``winners`` with their records, as ``e``."""
    columns = [c for c in enrichments.columns if c != "job_id"]
    eligible = (F.col("schema_version") == schema_version) & F.col("enrichment_id").isNotNull()
    records = enrichments.filter(eligible).select(
        F.col("job_id").alias("_job"), F.struct("created_at", "enrichment_id", *more).alias("_this"), F.struct(*columns).alias("e")
    )
    # As two bounds, since Spark would deal both sides by every column compared for equality.
    won = (F.col("job_id") == F.col("_job")) & (F.col("_this") >= F.col("_winner")) & (F.col("_this") <= F.col("_winner"))
    return facts.join(records, won, "left").drop("_winner", "_job", "_this")


def enrichment_facts(jobs: DataFrame, enrichments: DataFrame, schema_version: str = "v3") -> DataFrame:
    """Per job: latest record of the current content, and the salary range of other contents."""
    # The winner is chosen on narrow columns; its record is joined back, by the job alone: rows
    # that lie by job, and the facts, stay where they are.
    return won_records(winners(jobs, enrichments, schema_version), enrichments, schema_version)


def version_facts(versions: DataFrame) -> DataFrame:
    """Per job: number of superseded versions and the extremes of title and location.

    A value differs from some version exactly when it differs from an extreme,
    which needs no join per version.
    """
    return versions.groupBy("job_id").agg(*version_aggregates(F.struct("title", "location")))


def version_aggregates(version: Column) -> list[Column]:
    """The facts from structs of title and location; a NULL struct is no version."""
    title, location = (F.when(version.isNotNull(), F.struct(version[c].alias(c))) for c in ("title", "location"))
    return [
        F.nullif(F.count(version), F.lit(0)).alias("_versions"),
        F.min(title).alias("_title_lo"),
        F.max(title).alias("_title_hi"),
        F.min(location).alias("_location_lo"),
        F.max(location).alias("_location_hi"),
    ]


def change_facts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max(change_time()).alias("last_changed_at"))


def change_time() -> Column:
    return F.when(F.col("event_type") == "changed", F.col("occurred_at"))


def _differs(value: Column, low: str, high: str) -> Column:
    here = F.struct(value)
    return F.col(low).isNotNull() & ~(here.eqNullSafe(F.col(low)) & here.eqNullSafe(F.col(high)))


def canonical_jobs(
    jobs: DataFrame, enrichments: DataFrame, versions: DataFrame, events: DataFrame, as_of, schema_version: str = "v3"
) -> DataFrame:
    """One flat row per job: identity, timing, enrichment and history.

    Every side is first reduced to one row per job, so the joins share the
    hash partitioning on ``job_id`` and none can be skewed.
    """
    require_view_columns(jobs, enrichments)
    joined = (
        jobs.join(enrichment_facts(jobs, enrichments, schema_version), "job_id", "left")
        .join(version_facts(versions), "job_id", "left")
        .join(change_facts(events), "job_id", "left")
    )
    return present(joined, as_of)


def require_view_columns(jobs: DataFrame, enrichments: DataFrame) -> None:
    missing = {*JOB_COLUMNS} - {*jobs.columns} | {*ENRICHMENT_COLUMNS} - {*enrichments.columns}
    if missing:
        raise ValueError(f"the view needs columns {sorted(missing)}")


def present(joined: DataFrame, as_of) -> DataFrame:
    """The view's columns from jobs joined with their facts; ages are counted up to ``as_of``."""
    now = instant(as_of)
    seen = F.coalesce("posted_at", "first_seen_at")
    e = F.col("e")
    old_salary = F.struct(e["salary_min"], e["salary_max"])
    salary_changed = F.col("_lowest_salary").isNotNull() & ~(
        old_salary.eqNullSafe(F.col("_lowest_salary")) & old_salary.eqNullSafe(F.col("_highest_salary"))
    )
    return joined.select(
        "job_id",
        *JOB_COLUMNS,
        F.col("company").alias("company_name"),
        F.col("title").alias("original_title"),
        freshness_hours(seen, now).alias("freshness_hours"),
        freshness_source(F.col("posted_at"), F.col("posted_at_source")).alias("freshness_source"),
        F.col("last_seen_at").alias("last_verified_at"),
        age_bucket(seen, now).alias("job_age_bucket"),
        *[e[c].alias(c) for c in ENRICHMENT_COLUMNS],
        F.coalesce(e["skill_count"], F.lit(0)).alias("skill_count"),
        F.coalesce(e["workplace_type"], F.col("workplace_type")).alias("workplace_type"),
        F.coalesce(e["employment_type"], F.col("employment_type")).alias("employment_type"),
        e["confidence"].alias("classification_confidence"),
        (F.coalesce("_versions", F.lit(0)) + 1).alias("version_count"),
        "last_changed_at",
        _differs(F.col("title"), "_title_lo", "_title_hi").alias("title_changed"),
        _differs(F.col("location"), "_location_lo", "_location_hi").alias("location_changed"),
        F.when(e["enrichment_id"].isNotNull(), salary_changed).alias("salary_changed"),
        days_active(F.col("first_seen_at"), F.col("removed_at"), now).alias("days_active"),
    )


def jobs_without_enrichment(jobs: DataFrame, enrichments: DataFrame, schema_version: str = "v3") -> DataFrame:
    have = enrichments.filter(F.col("schema_version") == schema_version).select("job_id", "content_hash")
    return jobs.join(have, ["job_id", "content_hash"], "left_anti")


# --- job list ---------------------------------------------------------------


def job_list(public: DataFrame, canonical: DataFrame, posted_since=None) -> DataFrame:
    """Published jobs in list form, newest first (page with ``offset``/``limit``)."""
    if posted_since is not None:
        public = public.filter(F.col("posted_at") >= instant(posted_since))
        canonical = canonical.filter(F.col("posted_at") >= instant(posted_since))
    rows = canonical.join(public.select("job_id"), "job_id", "left_semi")
    return rows.select(
        "*",
        F.col("job_id").alias("id"),
        F.col("company_name").alias("company"),
        F.col("original_title").alias("title"),
        F.left(F.col("description_text"), F.lit(300)).alias("description_excerpt"),
    ).orderBy(F.desc(F.coalesce("posted_at", "first_seen_at")), F.desc("job_id"))


def job_count(public: DataFrame, posted_since=None) -> DataFrame:
    if posted_since is not None:
        public = public.filter(F.col("posted_at") >= instant(posted_since))
    return public.agg(F.count(F.lit(1)).alias("total"))


def repair_array(text: Column) -> Column:
    """Legacy JSON column as a list: an object gives its keys, anything else an empty list."""
    items = F.from_json(text, "array<string>")
    keys = F.map_keys(F.from_json(text, "map<string,string>"))
    is_list = F.json_array_length(text).isNotNull()
    return F.coalesce(F.when(is_list, items), F.when(~is_list, keys), keys, F.array().cast("array<string>"))


def array_or_empty(text: Column) -> Column:
    """JSON array text as a list, an empty list for any other JSON value."""
    empty = F.array().cast("array<string>")
    is_list = F.json_array_length(text).isNotNull()
    return F.coalesce(F.when(is_list, F.from_json(text, "array<string>")), empty)


# Source columns of each client field, in order of preference.
CLIENT_TEXT = {
    "company": ("company", "company_name", "organization"),
    "location": ("location", "job_location", "city"),
    "description": ("description_excerpt", "description"),
    "employment_type": ("employment_type", "job_type", "type"),
    "workplace_type": ("workplace_type", "work_mode", "remote_type"),
    "salary_currency": ("salary_currency", "currency"),
    "salary_period": ("salary_period",),
    "provider": ("provider", "source"),
    "job_url": ("job_url", "url"),
    "apply_url": ("apply_url", "application_url"),
    "job_family": ("job_family",),
    "job_subfamily": ("job_subfamily",),
    "seniority": ("seniority",),
}
CLIENT_NUMBERS = {
    "salary_min": ("salary_min", "min_salary"),
    "salary_max": ("salary_max", "max_salary"),
    "years_experience_min": ("years_experience_min",),
    "years_experience_max": ("years_experience_max",),
    "classification_confidence": ("classification_confidence",),
}


def _first(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    given = [F.col(n).cast("string") for n in names if n in df.columns]
    value = F.coalesce(*given) if given else F.lit(None).cast("string")
    return value if kind == "string" else value.try_cast(kind)


def _first_time(df: DataFrame, names: tuple[str, ...]) -> Column:
    given = [F.col(n).cast("string").try_cast("timestamp") for n in names if n in df.columns]
    return F.coalesce(*given) if given else F.lit(None).cast("timestamp")


def client_jobs(rows: DataFrame, detail: bool = False) -> DataFrame:
    """Search-page form of job rows; missing texts are empty, bad numbers NULL."""
    posted = _first_time(rows, ("posted_at", "date_posted"))
    observed = _first_time(rows, ("first_seen_at",))
    text = dict(CLIENT_TEXT, description=("description_text", "description_excerpt")) if detail else CLIENT_TEXT
    columns = {name: F.coalesce(_first(rows, names, "string"), F.lit("")) for name, names in text.items()}
    columns["company"] = columns["company"] if detail else decode_percent(columns["company"])
    numbers = {name: _first(rows, names, "double") for name, names in CLIENT_NUMBERS.items()}
    lists = {
        name: F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.isNotNull())
        for name in ("related_roles", "skills")
        if name in rows.columns
    }
    places = {"ai_locations": F.col("ai_locations")} if "ai_locations" in rows.columns else {}
    return rows.select(
        F.coalesce(*[F.col(c) for c in ("id", "job_id") if c in rows.columns]).alias("id"),
        F.coalesce(_first(rows, ("title", "job_title", "position"), "string"), F.lit("Untitled role")).alias("title"),
        *[c.alias(n) for n, c in columns.items()],
        *[F.when(~F.isnan(c), c).alias(n) for n, c in numbers.items()],
        *[c.alias(n) for n, c in (lists | places).items()],
        F.coalesce(posted, observed).alias("created_at"),
        F.when(posted.isNotNull(), "posted").when(observed.isNotNull(), "observed").alias("date_source"),
    )


def location_labels(location: Column, ai_locations: Column) -> Column:
    """Raw location and the label of every extracted location, distinct and non-empty."""

    def label(x: Column) -> Column:
        state = F.when(F.coalesce(x["state_code"], F.lit("")) != "", x["state_code"]).otherwise(x["state"])
        return F.when(F.coalesce(x["remote"], F.lit(False)), "Remote").otherwise(
            comma_label(x["city"], state, x["country_code"], trimmed=False)
        )

    labels = F.concat(F.array(location), F.coalesce(F.transform(ai_locations, label), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != "")))
