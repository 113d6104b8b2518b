"""Which jobs may be enriched."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hirelake.functions.scalar import instant


def window_reason(days: int) -> str:
    return f"older_than_{days}_day" + ("" if days == 1 else "s")


def window_start(as_of, days: int = 1) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def eligibility_reason(
    posted_at: Column, is_us: Column, as_of, window_days: int = 1, undated_eligible: bool = False
) -> Column:
    """Why a job is not eligible, NULL when it is.  Exactly ``window_days`` old is eligible."""
    reason = F.when(~is_us, "non_us")
    if not undated_eligible:
        reason = reason.when(posted_at.isNull(), "missing_posted_at")
    return reason.when(posted_at < window_start(as_of, window_days), window_reason(window_days))


def status_of(reason: Column) -> Column:
    return F.when(reason.isNull(), "eligible").otherwise("not_eligible")


def eligibility(posted_at: Column, is_us: Column, as_of, **options) -> Column:
    reason = eligibility_reason(posted_at, is_us, as_of, **options)
    return F.struct(status_of(reason).alias("status"), reason.alias("reason"))
