"""Company identities: exact name keys, slugs and assignment to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import instant
from hirelake.functions.unicode import display_name, distinct_slug, name_key, name_slug
from hirelake.operators.joins import many_rows
from hirelake.sources.store import first_per_key


def new_company_id(key: Column) -> Column:
    """Stable 128-bit id of a company's identity key."""
    return F.left(F.sha2(F.concat(F.lit("company:"), key), 256), F.lit(32))


def named(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct display names with identity key; blank names are dropped.

    The distinct runs before the Arrow UDF, so each spelling crosses into
    Python once however many postings carry it.
    """
    shown = names.select(display_name(F.col(name)).alias("name")).filter(F.col("name") != "").distinct()
    return shown.withColumn("normalized_name", name_key("name"))


def missing_companies(existing: DataFrame, names: DataFrame, as_of, name: str = "name") -> DataFrame:
    """Rows to add to ``existing`` for names whose identity key is new.

    A slug already taken, by an existing company or by another new one, gets
    the key's hash digits appended; the smallest key keeps the plain slug.
    """
    fresh = named(names, name).join(existing.select("normalized_name"), "normalized_name", "left_anti")
    fresh = first_per_key(fresh, ["normalized_name"], [F.col("name")])
    fresh = fresh.withColumn("slug", name_slug("name"))
    taken = existing.select("slug", F.lit(True).alias("_taken")).distinct()
    owner = fresh.groupBy("slug").agg(F.min("normalized_name").alias("_owner"))
    placed = fresh.join(many_rows(owner.join(many_rows(taken), "slug", "left")), "slug", "left")
    plain = F.col("_taken").isNull() & (F.col("_owner") == F.col("normalized_name"))
    return placed.select(
        new_company_id(F.col("normalized_name")).alias("company_id"),
        "name",
        "normalized_name",
        F.when(plain, F.col("slug"))
        .otherwise(distinct_slug(F.col("slug"), F.col("normalized_name")))
        .alias("slug"),
        F.lit(None).cast("string").alias("website_domain"),
        instant(as_of).alias("tracking_started_at"),
    )


def ensure_companies(existing: DataFrame, names: DataFrame, as_of, name: str = "name") -> DataFrame:
    """``existing`` plus missing companies; tracking starts where it had not."""
    seen = named(names, name).select("normalized_name").distinct().withColumn("_seen", F.lit(True))
    started = F.when(F.col("_seen"), F.coalesce("tracking_started_at", instant(as_of))).otherwise(
        F.col("tracking_started_at")
    )
    kept = existing.join(seen, "normalized_name", "left").withColumn("tracking_started_at", started).drop("_seen")
    return kept.unionByName(missing_companies(existing, names, as_of, name), allowMissingColumns=True)


def assign_companies(postings: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Set ``company_id`` and ``company``: the source's company wins over the posting's name."""
    names = companies.select(F.col("company_id").alias("_source_company"), F.col("name").alias("_source_name"))
    owned = sources.select("source_id", F.col("company_id").alias("_source_company"))
    owner = owned.join(many_rows(names), "_source_company", "left")
    # Distinct posting names are joined to companies once, not per posting.
    keyed = (
        postings.select("company")
        .distinct()
        .withColumn("normalized_name", name_key(display_name(F.col("company"))))
        .join(companies.select("normalized_name", F.col("company_id").alias("_named_company")), "normalized_name")
        .select("company", "_named_company")
    )
    with_owner = postings.join(many_rows(owner), "source_id", "left")
    joined = with_owner.join(many_rows(keyed), "company", "left")
    return (
        joined.withColumn("company_id", F.coalesce("_source_company", "_named_company"))
        .withColumn("company", F.coalesce("_source_name", "company"))
        .drop("_source_company", "_source_name", "_named_company")
    )


def link_sources(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """Give sources without a company the company of their first assigned posting."""
    first = (
        postings.filter(F.col("company_id").isNotNull())
        .groupBy("source_id")
        .agg(F.min_by("company_id", "pos").alias("_linked"))
    )
    linked = F.coalesce("company_id", "_linked")
    return sources.join(many_rows(first), "source_id", "left").withColumn("company_id", linked).drop("_linked")
