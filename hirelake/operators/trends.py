"""Market, role, skill and company trends over stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import change_between, day as day_literal
from hirelake.operators.joins import one_row
from hirelake.operators.snapshots import coverage
from hirelake.sources.store import last_per_key

MIN_COVERAGE = 0.5
LAGS = (7, 30)


def target_day(snapshots: DataFrame, day=None) -> DataFrame:
    """One row: the given day, else the latest snapshot day (NULL without snapshots)."""
    latest = F.max("snapshot_date")
    return snapshots.agg(latest.alias("day") if day is None else F.coalesce(day_literal(day), latest).alias("day"))


def on_target(snapshots: DataFrame, target: DataFrame) -> DataFrame:
    """Snapshot rows of the target day; prunes partitions at run time."""
    return snapshots.join(one_row(target), F.col("snapshot_date") == F.col("day"), "left_semi")


def market_snapshot(snapshots: DataFrame, day=None) -> DataFrame:
    """One row of market totals, also when there are no snapshots for the day."""
    target = target_day(snapshots, day)
    totals = on_target(snapshots, target).groupBy("snapshot_date").agg(
        F.count("company_id").alias("companies_tracked"),
        *[F.sum(c).alias(c) for c in ("total_open_jobs", "new_jobs", "removed_jobs", "changed_jobs", "enriched_jobs")],
    )
    return (
        target.join(totals, F.col("day") == F.col("snapshot_date"), "left")
        .drop("snapshot_date")
        .withColumnRenamed("day", "snapshot_date")
        .fillna(0, [c for c in totals.columns if c != "snapshot_date"])
    )


def market_total_on(snapshots: DataFrame, day) -> DataFrame:
    return snapshots.filter(F.col("snapshot_date") == day_literal(day)).agg(F.sum("total_open_jobs").alias("total"))


def market_coverage(market: DataFrame) -> DataFrame:
    share = coverage(F.col("enriched_jobs"), F.col("total_open_jobs"))
    return market.withColumn("enrichment_coverage", share).withColumn("available", share >= MIN_COVERAGE)


def trends(snapshots: DataFrame) -> DataFrame:
    """Market totals with the change against exactly 7 and 30 days earlier."""
    market = market_coverage(market_snapshot(snapshots))
    lagged = market.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.date_sub("snapshot_date", n).alias("day")) for n in LAGS]))
    )
    # Two one-day totals; each needs only its own partition.
    earlier = (
        snapshots.join(F.broadcast(lagged), F.col("snapshot_date") == F.col("day"))
        .groupBy()
        .agg(*[F.sum(F.when(F.col("lag") == n, F.col("total_open_jobs"))).alias(f"total_{n}d") for n in LAGS])
    )
    joined = market.withColumn("_one", F.lit(1)).join(one_row(earlier.withColumn("_one", F.lit(1))), "_one").drop("_one")
    for n in LAGS:
        joined = joined.withColumn(f"change_{n}d", change_between(F.col("total_open_jobs"), F.col(f"total_{n}d")))
    return joined.drop(*[f"total_{n}d" for n in LAGS])


def top_names(
    histograms: DataFrame, snapshots: DataFrame, dimension: str, limit: int = 50, gated: bool = False
) -> DataFrame:
    """Most frequent names of a dimension on the latest day, optionally coverage-gated."""
    target = target_day(snapshots)
    counts = (
        on_target(histograms.filter(F.col("dimension") == dimension), target)
        .groupBy("name")
        .agg(F.sum("count").alias("count"))
    )
    if gated:
        gate = market_coverage(market_snapshot(snapshots)).filter("available").select(F.lit(True).alias("_open"))
        counts = counts.withColumn("_open", F.lit(True)).join(one_row(gate), "_open", "left_semi").drop("_open")
    return counts.orderBy(F.desc("count"), "name").limit(limit)


def name_detail(
    companies: DataFrame, snapshots: DataFrame, histograms: DataFrame, dimension: str, name: str
) -> DataFrame:
    """Companies counting a role or skill on the latest day, with enough coverage."""
    target = target_day(snapshots)
    wanted = histograms.filter((F.col("dimension") == dimension) & (F.col("name") == name))
    covered = on_target(snapshots, target).filter(F.col("enrichment_coverage") >= MIN_COVERAGE)
    return (
        on_target(wanted, target)
        .select("company_id", "count")
        .join(covered.select("company_id", "snapshot_date", "enrichment_coverage"), "company_id")
        .join(companies.select("company_id", F.col("name").alias("company"), "slug"), "company_id")
        .orderBy(F.desc("count"), "company")
    )


def latest_snapshot(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every company with its latest snapshot, if any."""
    return companies.join(last_per_key(snapshots, ["company_id"], [F.col("snapshot_date")]), "company_id", "left")


def company_history(snapshots: DataFrame, as_of_day, days: int = 31, company_id=None) -> DataFrame:
    """Snapshot rows of the trailing days, newest first; of one company if given."""
    since = F.date_sub(day_literal(as_of_day), days)
    rows = snapshots.filter(F.col("snapshot_date") >= since)
    if company_id is not None:
        rows = rows.filter(F.col("company_id") == company_id)
    return rows.orderBy(F.desc("snapshot_date"), "company_id")


def _lagged_value(name: str, lag: int) -> Column:
    return F.max(F.when(F.col("snapshot_date") == F.date_sub("latest_date", lag), F.col(name)))


def company_trends(snapshots: DataFrame, as_of_day, days: int = 31) -> DataFrame:
    """Per company: latest open jobs and the change against exactly 7 and 30 days before.

    A missing day gives no change; the nearest day is never used instead.
    """
    recent = snapshots.filter(F.col("snapshot_date") >= F.date_sub(day_literal(as_of_day), days))
    latest = recent.groupBy("company_id").agg(F.max("snapshot_date").alias("latest_date"))
    wanted = recent.join(latest, "company_id").filter(
        F.datediff("latest_date", "snapshot_date").isin(0, *LAGS)
    )
    values = wanted.groupBy("company_id", "latest_date").agg(
        _lagged_value("total_open_jobs", 0).alias("total_open_jobs"),
        *[_lagged_value("total_open_jobs", n).alias(f"open_{n}d") for n in LAGS],
    )
    for n in LAGS:
        values = values.withColumn(f"change_{n}d", change_between(F.col("total_open_jobs"), F.col(f"open_{n}d")))
    return values.drop(*[f"open_{n}d" for n in LAGS])
