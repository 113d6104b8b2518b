"""Data-quality rules evaluated together in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Allowed statuses.
EVENT_TYPES = ("created", "changed", "removed", "reactivated")
QUEUE_STATUSES = ("pending", "processing", "completed", "failed", "not_eligible")
TOKEN_COLUMNS = ("input_tokens", "output_tokens", "thought_tokens", "cached_tokens", "total_tokens")


def one_of(name: str, allowed: tuple[str, ...]) -> Column:
    return F.col(name).isin(*allowed)


def ordered_range(low: str, high: str) -> Column:
    lo, hi = F.col(low), F.col(high)
    return (
        (lo.isNull() | (lo >= 0)) & (hi.isNull() | (hi >= 0)) & (lo.isNull() | hi.isNull() | (lo <= hi))
    )


def between(name: str, low: float, high: float) -> Column:
    return F.col(name).isNull() | F.col(name).between(low, high)


QUEUE_RULES = {
    "queue_status": lambda: one_of("status", QUEUE_STATUSES),
    "queue_priority": lambda: F.col("priority").between(1, 3),
    "queue_attempts": lambda: F.col("attempts") >= 0,
}
JOB_RULES = {
    "ready_hash": lambda: (F.col("classification_status") != "ready")
    | (F.col("classified_content_hash") == F.col("content_hash")),
}
EVENT_RULES = {"event_type": lambda: one_of("event_type", EVENT_TYPES)}
ENRICHMENT_RULES = {
    "experience_range": lambda: ordered_range("years_experience_min", "years_experience_max"),
    "confidence": lambda: between("confidence", 0.0, 1.0),
    "token_counts": lambda: reduce(lambda a, b: a & b, (F.col(c) >= 0 for c in TOKEN_COLUMNS)),
}


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, n): rows breaking each rule.  As in SQL checks, an unknown result passes."""
    counts = df.agg(*[F.count(F.when(~rule(), 1)).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    return counts.select(F.inline(pairs))


def missing_and_extra(payload_keys: Column, required: Column) -> Column:
    """STRUCT(missing, extra) keys of a record against the required set."""
    return F.struct(
        F.array_sort(F.array_except(required, payload_keys)).alias("missing"),
        F.array_sort(F.array_except(payload_keys, required)).alias("extra"),
    )
