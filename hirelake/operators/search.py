"""Faceted job search over client-form job rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import hours_old, instant
from hirelake.operators.canonical import location_labels

# Facet groups whose value is one text column.
TEXT_FACETS = {
    "workplace": "workplace_type",
    "employment": "employment_type",
    "company": "company",
    "source": "provider",
}
AGE_HOURS = (24, 48)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def within_hours(hours: int, as_of) -> Column:
    """Exactly dated and at most ``hours`` old."""
    dated = F.coalesce(F.col("date_source") == "posted", F.lit(False))
    return dated & (hours_old(F.col("created_at"), instant(as_of)) <= hours)


def recent_jobs(rows: DataFrame, as_of, hours: int = 48) -> DataFrame:
    """Rows with an exact posted date from the last ``hours``; the future is excluded."""
    now = instant(as_of)
    return rows.filter(
        (F.col("posted_at") >= now - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.col("posted_at") <= now)
    )


def experience_matches(value: str) -> Column:
    years = F.col("years_experience_min")
    if value.startswith("seniority:"):
        return F.coalesce(F.col("seniority") == value.removeprefix("seniority:"), F.lit(False))
    buckets = {"years:entry": years <= 2, "years:mid": years.between(3, 5), "years:senior": years >= 6}
    return F.coalesce(buckets.get(value, buckets["years:senior"]), F.lit(False))


def _skill_keys() -> Column:
    return F.array_distinct(F.transform("skills", F.lower))


def place_labels() -> Column:
    return location_labels(F.col("location"), F.col("ai_locations"))


def facet_condition(group: str, value: str, as_of) -> Column:
    if group == "datePosted":
        return within_hours(int(value), as_of)
    if group == "location":
        return F.array_contains(place_labels(), value)
    if group == "role":
        kind, _, name = value.partition(":")
        return F.col("job_family" if kind == "family" else "job_subfamily") == name
    if group == "experience":
        return experience_matches(value)
    if group == "skill":
        return F.array_contains(_skill_keys(), value)
    return F.col(TEXT_FACETS[group]) == value


def text_matches(needle: str) -> Column:
    """Case-insensitive substring of any searched text or list item."""
    wanted = F.lit(needle.strip().lower())
    texts = [F.col(c) for c in ("title", "company", "description", "job_family", "job_subfamily")]
    in_text = _any([F.contains(F.lower(t), wanted) for t in texts])
    in_list = [F.exists(F.col(c), lambda x: F.contains(F.lower(x), wanted)) for c in ("skills", "related_roles")]
    return in_text | _any(in_list)


def place_matches(needle: str) -> Column:
    wanted = F.lit(needle.strip().lower())
    return F.exists(place_labels(), lambda x: F.contains(F.lower(x), wanted))


# Sort order of search results; undated rows sort as oldest.
SORTS = {
    "newest": lambda: F.col("created_at").desc_nulls_last(),
    "oldest": lambda: F.col("created_at").asc_nulls_first(),
    "company": lambda: F.col("company").asc(),
}


def search(
    jobs: DataFrame,
    as_of,
    query: str = "",
    place: str = "",
    filters: dict[str, list[str]] | None = None,
    hidden: DataFrame | None = None,
    saved: DataFrame | None = None,
) -> DataFrame:
    """Jobs matching every given filter group (any value within a group).

    ``hidden`` and ``saved`` are tables of job ids of one user.
    """
    if hidden is not None:
        jobs = jobs.join(hidden.select("id"), "id", "left_anti")
    if saved is not None:
        jobs = jobs.join(saved.select("id"), "id", "left_semi")
    if query.strip():
        jobs = jobs.filter(text_matches(query))
    if place.strip():
        jobs = jobs.filter(place_matches(place))
    for group, values in (filters or {}).items():
        if values:
            jobs = jobs.filter(_any([facet_condition(group, v, as_of) for v in values]))
    return jobs


def page(results: DataFrame, number: int = 1, sort: str = "newest", size: int = 12) -> DataFrame:
    """One page of sorted results; ties are ordered by id."""
    ordered = results.orderBy(SORTS[sort](), "id")
    start = (number - 1) * size
    return (ordered.offset(start) if start else ordered).limit(size)


def result_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("company").alias("companies"))


def facets(jobs: DataFrame, as_of) -> DataFrame:
    """(group, value, label, count) of every filter option over all loaded jobs.

    Age and years options are listed even at zero.  A job emits a list as long
    as its values; the counts combine on the map side.
    """
    return (
        jobs.select(F.inline(facet_options(as_of)))
        .where("value IS NOT NULL")
        .groupBy("group", "value")
        .agg(F.min("label").alias("label"), F.sum("hit").alias("count"))
    )


def facet_options(as_of) -> Column:
    """The options of a job, as an array of (group, value, label, hit)."""

    def option(group: str, value: Column, label: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(group).alias("group"), value.alias("value"), label.alias("label"), hit.cast("bigint").alias("hit")
        )

    def plain(group: str, value: Column, prefix: str = "") -> Column:
        return option(group, F.concat(F.lit(prefix), F.nullif(value, F.lit(""))), value, F.lit(1))

    def fixed(group: str, value: str, hit: Column) -> Column:
        return option(group, F.lit(value), F.lit(value), F.coalesce(hit, F.lit(False)).cast("int"))

    scalars = F.array(
        *[fixed("datePosted", str(h), within_hours(h, as_of)) for h in AGE_HOURS],
        plain("role", F.col("job_family"), "family:"),
        plain("role", F.col("job_subfamily"), "subfamily:"),
        plain("experience", F.col("seniority"), "seniority:"),
        *[fixed("experience", v, experience_matches(v)) for v in ("years:entry", "years:mid", "years:senior")],
        *[plain(group, F.col(column)) for group, column in TEXT_FACETS.items()],
    )
    nothing = F.lit(None).cast("string")
    return F.concat(
        scalars,
        F.transform(place_labels(), lambda p: option("location", p, p, F.lit(1))),
        # A key counts once a job; its spellings only add labels.
        F.transform(_skill_keys(), lambda k: option("skill", k, nothing, F.lit(1))),
        F.transform("skills", lambda s: option("skill", F.lower(s), s, F.lit(0))),
    )


def distinct_values(jobs: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values of a text or list column."""
    is_list = jobs.schema[column].dataType.typeName() == "array"
    values = jobs.select((F.explode(column) if is_list else F.col(column)).alias("value"))
    return values.filter(F.col("value") != "").distinct().orderBy("value")
