"""Source inventory: merging candidate feeds, repairs, promotion to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import (
    SUPPORTED_PROVIDERS,
    board_slug,
    instant,
    is_supported,
    provider_stored,
    stored_slug,
)
from hirelake.sources.store import absent, keep_old, prefer_new, upsert

# Statuses from most to least advanced.
STATUS_ORDER = ("promoted", "valid", "validating", "pending")


def _rank(status: Column) -> Column:
    rank = None
    for i, s in enumerate(STATUS_ORDER):
        rank = F.when(status == s, i) if rank is None else rank.when(status == s, i)
    return rank.otherwise(len(STATUS_ORDER))


def _board(provider: Column, url: Column, slug: Column) -> Column:
    return F.coalesce(F.when(is_supported(provider), board_slug(url)), slug)


def merge_candidates(*feeds: DataFrame) -> DataFrame:
    """One candidate per provider and slug.

    The first URL and name of each feed count; the CSV URL and the table's name
    are preferred.  First means smallest input position, taken by an aggregate
    that combines on the map side.
    """
    rows = feeds[0]
    for feed in feeds[1:]:
        rows = rows.unionByName(feed)
    rows = rows.filter("is_valid")

    def first(column: str, origin: str) -> Column:
        given = (F.col("origin") == origin) & F.col(column).isNotNull()
        return F.min_by(column, F.when(given, F.col("pos")))

    merged = rows.groupBy("provider", "source_slug").agg(
        first("canonical_url", "csv").alias("_csv_url"),
        first("canonical_url", "parquet").alias("_parquet_url"),
        first("company_name", "csv").alias("_csv_name"),
        first("company_name", "parquet").alias("_parquet_name"),
        F.bool_or(F.col("origin") == "csv").alias("in_csv"),
        F.bool_or(F.col("origin") == "parquet").alias("in_parquet"),
        F.count(F.lit(1)).alias("rows_merged"),
    )
    staged = merged.withColumn("canonical_url", F.coalesce("_csv_url", "_parquet_url"))
    return staged.select(
        "provider",
        "source_slug",
        "canonical_url",
        F.coalesce("_parquet_name", "_csv_name").alias("company_name"),
        _board(F.col("provider"), F.col("canonical_url"), F.col("source_slug")).alias("board_id"),
        "in_csv",
        "in_parquet",
        "rows_merged",
    )


def feed_counts(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(~F.col("is_valid"), 1)).alias("skipped"),
    )


def import_report(candidates: DataFrame) -> DataFrame:
    """One row of import totals."""
    return candidates.agg(*import_figures())


def import_figures() -> list[Column]:
    """The totals of an import, for an aggregate or for ``store.append_counted``."""

    def count(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    in_csv, in_parquet, supported = F.col("in_csv"), F.col("in_parquet"), is_supported("provider")
    return [
        F.count(F.lit(1)).alias("normalized_candidates"),
        F.coalesce(F.sum(F.col("rows_merged") - 1), F.lit(0)).alias("duplicates_merged"),
        count(in_csv & ~in_parquet, "csv_only"),
        count(~in_csv & in_parquet, "parquet_only"),
        count(in_csv & in_parquet, "overlapping"),
        count(supported, "supported_pending"),
        count(~supported, "unsupported_pending"),
        count(F.col("canonical_url").isNotNull(), "with_canonical_url"),
        count(F.col("canonical_url").isNull(), "without_canonical_url"),
    ]


def provider_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).orderBy("provider")


def insert_counts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """How many candidate keys are new to the table and how many update it."""
    known = existing.select("provider", "source_slug").dropna().distinct().withColumn("_known", F.lit(True))
    return candidates.join(known, ["provider", "source_slug"], "left").agg(
        F.count(F.when(F.col("_known").isNull(), 1)).alias("inserted"),
        F.count("_known").alias("updated"),
    )


def upsert_candidates(existing: DataFrame, candidates: DataFrame, as_of) -> DataFrame:
    """Stage merged candidates; only unsupported providers fall back to pending."""
    updates = candidates.select(
        "provider", "source_slug", "canonical_url", "board_id", "company_name",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("validation_error"),
        F.lit(0).alias("validation_attempts"), F.lit(None).cast("timestamp").alias("last_validated_at"),
        instant(as_of).alias("updated_at"),
    )
    supported = F.col("old_provider").isin(*SUPPORTED_PROVIDERS)

    def reset_unsupported(old: Column, new: Column) -> Column:
        return F.when(supported, old).otherwise(new)

    reset = ("status", "validation_error", "validation_attempts", "last_validated_at")
    policies = {c: reset_unsupported for c in reset} | {
        c: prefer_new for c in ("canonical_url", "board_id", "company_name")
    }
    return upsert(existing, updates, ["provider", "source_slug"], policies)


def upsert_sources(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stage candidates as unverified sources; the status of known sources stays."""
    updates = candidates.select(
        "provider", "source_slug", "canonical_url", "board_id", F.lit("not_verified").alias("status")
    )
    policies = {"canonical_url": prefer_new, "board_id": prefer_new, "status": keep_old}
    return upsert(sources, updates, ["provider", "source_slug"], policies)


def new_inventory(inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """Inventory rows whose URL and slug are both new; one row per slug."""
    fresh = absent(inventory, sources, ["provider", "canonical_url"], ["provider", "source_slug"])
    one = fresh.groupBy("provider", "source_slug").agg(F.min_by(F.struct("canonical_url", "board_id"), "pos").alias("r"))
    return one.select(
        "provider", "source_slug", F.col("r.canonical_url"), F.col("r.board_id"), F.lit("not_verified").alias("status")
    )


def repair_candidates(candidates: DataFrame) -> DataFrame:
    """Normalise stored provider, URL and slug."""
    url = F.nullif(F.trim("canonical_url"), F.lit(""))
    return (
        candidates.withColumn("provider", provider_stored("provider"))
        .withColumn("source_slug", stored_slug("source_slug", "board_id", "canonical_url"))
        .withColumn("canonical_url", url)
    )


def merge_duplicates(candidates: DataFrame) -> DataFrame:
    """One row per provider and slug; the oldest id survives with the best values."""
    keyed = candidates.filter(F.col("source_slug").isNotNull())

    def blank(name: str) -> Column:
        return F.nullif(F.trim(name), F.lit("")).isNull()

    def best(name: str, worse: Column) -> Column:
        return F.min_by(name, F.struct(worse, F.col("candidate_id")))

    repeated = F.count(F.lit(1)) > 1
    board = best("board_id", blank("board_id"))
    chosen = {
        "canonical_url": best("canonical_url", F.col("canonical_url").isNull()),
        "board_id": F.when(repeated, F.coalesce(board, F.col("source_slug"))).otherwise(board),
        "company_name": best("company_name", blank("company_name")),
        "status": best("status", _rank(F.col("status"))),
        "validation_attempts": F.max("validation_attempts"),
        "last_validated_at": F.max("last_validated_at"),
        "candidate_id": F.min("candidate_id"),
    }
    keys = ["provider", "source_slug"]
    others = {c: F.min_by(c, "candidate_id") for c in candidates.columns if c not in chosen and c not in keys}
    merged = keyed.groupBy(*keys).agg(*[v.alias(c) for c, v in (chosen | others).items()])
    return merged.select(*candidates.columns).unionByName(candidates.filter(F.col("source_slug").isNull()))


def active_sources(sources: DataFrame, companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Active sources with their company name, by id."""
    names = companies.select("company_id", F.col("name").alias("company_name"))
    active = sources.filter(F.col("status") == "active")
    rows = active.join(names, "company_id", "left").orderBy("source_id")
    return rows if limit is None else rows.limit(limit)


def count_active(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status") == "active").agg(F.count(F.lit(1)).alias("active_sources"))


# --- promotion --------------------------------------------------------------


def eligible_candidates(candidates: DataFrame, as_of, cool_down_minutes: int = 15) -> DataFrame:
    """Candidates that may be promoted now, with their processing order."""
    cooled = F.col("last_validated_at").isNull() | (
        F.col("last_validated_at") < instant(as_of) - F.expr(f"INTERVAL '{cool_down_minutes}' MINUTE")
    )
    valid = F.col("status") == "valid"
    return candidates.filter(
        F.col("status").isin("pending", "valid")
        & F.col("provider").isin(*SUPPORTED_PROVIDERS)
        & (F.trim("canonical_url") != "")
        & (valid | cooled)
    ).withColumn("turn", F.struct(F.when(valid, 0).otherwise(1).alias("group"), "candidate_id"))


def plan_promotions(
    candidates: DataFrame, checks: DataFrame, sources: DataFrame, target: int, active: int, as_of
) -> DataFrame:
    """Candidates processed until ``target`` sources are active, with their outcome.

    ``checks``: candidate_id, outcome ('ok', 'transient', 'invalid'), error for
    candidates that need validation.  A candidate whose source is already
    active, or whose slug came up earlier, does not count as a transition.
    """
    missing = max(target - active, 0)
    checked = eligible_candidates(candidates, as_of).join(checks, "candidate_id", "left")
    outcome = F.when(F.col("status") == "valid", "ok").otherwise(F.coalesce("outcome", F.lit("transient")))
    slug = F.coalesce("board_id", board_slug("canonical_url"))
    tried = checked.withColumn("outcome", outcome).withColumn("source_slug", slug)
    running = sources.filter(F.col("status") == "active").select("provider", "source_slug")
    first_turn = (
        tried.filter(F.col("outcome") == "ok")
        .join(running, ["provider", "source_slug"], "left_anti")
        .groupBy("provider", "source_slug")
        .agg(F.min("turn").alias("turn"))
    )
    # The promotions that reach the target: a bounded top-k, never a global window.
    chosen = first_turn.orderBy("turn").limit(missing)
    last = chosen.agg(F.max("turn").alias("_last"), F.count(F.lit(1)).alias("_added"))
    promotes = chosen.select(F.col("turn.candidate_id").alias("candidate_id"), F.lit(True).alias("_new"))
    processed = tried.join(F.broadcast(last), (F.col("_added") < missing) | (F.col("turn") <= F.col("_last")))
    return (
        processed.join(promotes, "candidate_id", "left")
        .withColumn("is_transition", F.coalesce("_new", F.lit(False)))
        .drop("_last", "_added", "_new")
    )


def apply_promotions(candidates: DataFrame, plan: DataFrame, as_of) -> DataFrame:
    """Candidate statuses after the plan: promoted, retried later, or invalid."""
    now = instant(as_of)
    outcomes = plan.select(
        "candidate_id", F.col("outcome").alias("_outcome"), F.col("error").alias("_error"),
        (F.col("status") != "valid").alias("_checked"),
    )
    done = F.col("_outcome").isNotNull()
    status = F.when(F.col("_outcome") == "ok", "promoted").when(F.col("_outcome") == "invalid", "invalid")
    values = {
        "status": F.when(done, status.otherwise("pending")).otherwise(F.col("status")),
        "validation_error": F.when(done, F.when(F.col("_outcome") != "ok", F.col("_error"))).otherwise(
            F.col("validation_error")
        ),
        "validation_attempts": F.col("validation_attempts") + F.coalesce(F.col("_checked").cast("int"), F.lit(0)),
        "last_validated_at": F.when(done, now).otherwise(F.col("last_validated_at")),
        "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
    }
    joined = candidates.join(outcomes, "candidate_id", "left")
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in candidates.columns])


def promoted_sources(sources: DataFrame, plan: DataFrame, as_of) -> DataFrame:
    """Sources after the plan: promoted boards are active."""
    ok = plan.filter(F.col("outcome") == "ok").groupBy("provider", "source_slug")
    updates = ok.agg(F.max_by("canonical_url", "turn").alias("canonical_url")).select(
        "provider", "source_slug", "canonical_url", F.col("source_slug").alias("board_id"),
        F.lit("active").alias("status"), instant(as_of).alias("last_attempt_at"),
        F.lit(None).cast("string").alias("last_error"),
    )
    return upsert(
        sources, updates, ["provider", "source_slug"], {"canonical_url": prefer_new, "board_id": prefer_new}
    )


def promotion_summary(plan: DataFrame, target: int, active: int) -> DataFrame:
    """One row; ``reached`` is false when the candidates do not suffice."""
    added = F.count(F.when(F.col("is_transition"), 1))
    rejected = F.count(F.when(F.col("outcome") == "invalid", 1))
    return plan.agg(
        added.alias("added"), rejected.alias("rejected"), (F.count(F.lit(1)) - added - rejected).alias("skipped")
    ).select(
        F.lit(target).alias("target"),
        F.lit(active).alias("active_before"),
        (F.lit(active) + F.col("added")).alias("active_after"),
        "added",
        "rejected",
        "skipped",
        (F.lit(active) + F.col("added") >= target).alias("reached"),
    )
