"""Readers for candidate lists and URL inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.functions.scalar import (
    board_slug,
    inventory_slug,
    is_supported,
    provider,
    strip,
    text_or_null,
    web_url,
)
from hirelake.sources.store import last_per_key


def require_columns(df: DataFrame, required: set[str]) -> DataFrame:
    missing = sorted(required.difference(df.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns; a byte-order mark before the header is ignored."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    return df.withColumn("pos", input_position()).toDF(*names, "pos")


def input_position() -> Column:
    """Row order within the scanned files."""
    return F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )


def csv_candidates(rows: DataFrame) -> DataFrame:
    """Candidates from a CSV list; the slug comes from the URL.  Keeps invalid rows, flagged."""
    require_columns(rows, {"ats_platform", "canonical_url", "company_name"})
    name, url = provider(F.col("ats_platform")), web_url("canonical_url")
    slug = strip(F.coalesce(board_slug(url), F.lit("")))
    return rows.select(
        name.alias("provider"),
        slug.alias("source_slug"),
        url.alias("canonical_url"),
        text_or_null("company_name").alias("company_name"),
        F.lit("csv").alias("origin"),
        F.col("pos"),
        ((name != "") & (slug != "")).alias("is_valid"),
    )


def parquet_candidates(rows: DataFrame) -> DataFrame:
    """Candidates from a company table that already has slugs."""
    require_columns(rows, {"ats", "slug", "name", "career_url"})
    name = provider(F.col("ats"))
    slug = F.coalesce(text_or_null("slug"), F.lit(""))
    return rows.select(
        name.alias("provider"),
        slug.alias("source_slug"),
        web_url("career_url").alias("canonical_url"),
        text_or_null("name").alias("company_name"),
        F.lit("parquet").alias("origin"),
        F.col("pos"),
        ((name != "") & (slug != "")).alias("is_valid"),
    )


def read_candidate_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_candidates(read_csv(spark, path))


def read_candidate_parquet(spark: SparkSession, path: str) -> DataFrame:
    return parquet_candidates(spark.read.parquet(path).withColumn("pos", input_position()))


def url_inventory(rows: DataFrame) -> DataFrame:
    """Every row of a URL inventory with provider, slug and board id; invalid rows flagged."""
    require_columns(rows, {"canonical_url", "ats_platform"})
    staged = rows.select(
        provider(F.col("ats_platform")).alias("provider"), web_url("canonical_url").alias("canonical_url"), "pos"
    )
    name, url = F.col("provider"), F.col("canonical_url")
    return staged.select(
        "provider",
        inventory_slug(name, url).alias("source_slug"),
        "canonical_url",
        F.when(is_supported(name), board_slug(url)).alias("board_id"),
        "pos",
        ((name != "") & url.isNotNull()).alias("is_valid"),
    )


def unique_inventory(inventory: DataFrame) -> DataFrame:
    """One row per provider and URL, the last one read."""
    return last_per_key(inventory.filter("is_valid").drop("is_valid"), ["provider", "canonical_url"], [F.col("pos")])


def read_url_inventory(spark: SparkSession, path: str) -> DataFrame:
    return url_inventory(read_csv(spark, path))
