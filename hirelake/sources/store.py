"""Keyed upserts, inserts and publication on Parquet tables.

Parquet tables have no MERGE, so an upsert is a full outer join that yields the
next version of the table; ``replace_table`` then publishes it by rename.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

Policy = Callable[[Column, Column], Column]


# Update policies for one column of a matched row.
def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def prefer_new(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def prefer_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    policies: dict[str, Policy] | None = None,
    default: Policy = take_new,
    when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Next version of ``target``: unmatched updates inserted, matched rows merged.

    ``updates`` must hold at most one row per key.  ``when(old, new)`` limits
    which matched rows change; columns absent from ``updates`` are kept and are
    NULL on insert.
    """
    policies = policies or {}
    old = target.select(*[F.col(c).alias(f"old_{c}") for c in target.columns], F.lit(True).alias("_in_target"))
    new = updates.select(
        *[F.col(c).cast(target.schema[c].dataType).alias(f"new_{c}") for c in target.columns if c in updates.columns],
        F.lit(True).alias("_in_updates"),
    )
    on = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in keys]
    joined = old.join(new, on, "full_outer")
    inserted = F.col("_in_target").isNull()
    matched = F.col("_in_target") & F.col("_in_updates")
    if when is not None:
        matched = matched & when(lambda c: F.col(f"old_{c}"), lambda c: F.col(f"new_{c}"))

    def value(name: str) -> Column:
        before = F.col(f"old_{name}")
        if name not in updates.columns:
            return before.alias(name)
        after = F.col(f"new_{name}")
        merged = before if name in keys else policies.get(name, default)(before, after)
        return F.when(inserted, after).when(matched, merged).otherwise(before).alias(name)

    return joined.select(*[value(c) for c in target.columns])


def absent(candidates: DataFrame, target: DataFrame, *key_sets: Sequence[str]) -> DataFrame:
    """Candidates that match the target on none of the key sets."""
    for keys in key_sets:
        candidates = candidates.join(target.select(*keys).dropna().distinct(), list(keys), "left_anti")
    return candidates


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``, with map-side combining."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_per_key(df, keys, order, last=True)


def without(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``excluded``."""
    return rows.join(excluded.select(key), key, "left_anti")


def replace_table(df: DataFrame, table: str) -> None:
    """Publish ``df`` as the new version of a managed table that it may read from.

    The old version is dropped only when the new one is in place; a run that
    stops between the renames is undone by ``recover_table``.
    """
    spark = df.sparkSession
    recover_table(spark, table)
    staging, previous = f"{table}__next", f"{table}__previous"
    df.write.mode("overwrite").format("parquet").saveAsTable(staging)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {previous}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {previous}")


def recover_table(spark: SparkSession, table: str) -> None:
    """Undo an interrupted ``replace_table``; call it before reading the table."""
    previous = f"{table}__previous"
    if not spark.catalog.tableExists(previous):
        return
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE {previous}")
    else:
        spark.sql(f"ALTER TABLE {previous} RENAME TO {table}")


def append_rows(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append history rows, partitioned by day where a column is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_counted(df: DataFrame, path: str, figures: Sequence[Column], partition: str | None = None) -> DataFrame:
    """Append history rows and give the ``figures`` (named aggregates) over them as one row.

    They are counted as the rows are written, so nothing is computed or read again for
    them, and a task that is run again counts once.
    """
    seen = Observation()
    append_rows(df.observe(seen, *figures), path, partition)
    schema = df.limit(0).agg(*figures).schema
    return df.sparkSession.createDataFrame([tuple(seen.get[c] for c in schema.names)], schema)


def publish_days(df: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """Replace exactly the days contained in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)
