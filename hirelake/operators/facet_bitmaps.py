"""Facet counts of filtered jobs from stored bitmaps.

For every option of a filter (group, value) there is a bitmap of the numbers of its
jobs, one row for each 64 numbers among which it has any.  So an option of few jobs
(most companies) takes a row for each of them, not a page of empty bits, and one of
many takes a sixty-fourth.  The jobs of any filter are unions within a group and
intersections between groups, and the counts of all options among them are
intersections again, so a filter costs bitmaps and no job is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.operators.search import facet_options

# The option that every job has.
EVERY = ("every", "")


def _placed(jobs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` with the bucket of each job's ``number`` and its bit there."""
    return jobs.select(
        F.expr("number div 64").alias("bucket"), F.expr("shiftleft(1L, int(number % 64))").alias("bit"), *columns
    )


def bitmaps(jobs: DataFrame, as_of) -> DataFrame:
    """(group, value, bucket, bits) of client-form jobs with ``number``, a distinct bigint
    of 0 or more.  Options of age hold at ``as_of`` and are built anew for another instant."""
    every = F.array(F.struct(F.lit(EVERY[0]).alias("group"), F.lit(EVERY[1]).alias("value"), F.lit("").alias("label"), F.lit(1).cast("bigint").alias("hit")))
    options = _placed(jobs, F.inline(F.concat(facet_options(as_of), every)))
    return options.where("value IS NOT NULL AND hit > 0").groupBy("group", "value", "bucket").agg(F.bit_or("bit").alias("bits"))


def merge(*parts: DataFrame) -> DataFrame:
    """The bitmaps of all jobs from those of some each."""
    return reduce(DataFrame.unionByName, parts).groupBy("group", "value", "bucket").agg(F.bit_or("bits").alias("bits"))


def numbers(jobs: DataFrame) -> DataFrame:
    """(bucket, bits) of the numbers in ``jobs``, to take a search's result into a filter."""
    return _placed(jobs).groupBy("bucket").agg(F.bit_or("bit").alias("bits"))


def selected(stored: DataFrame, filters: dict[str, list[str]], *others: DataFrame) -> DataFrame:
    """(bucket, bits) of the jobs with any value of every group, and in all ``others``."""
    chosen = {g: v for g, v in filters.items() if v} | {EVERY[0]: [EVERY[1]]}
    wanted = reduce(lambda a, b: a | b, [(F.col("group") == g) & F.col("value").isin(v) for g, v in chosen.items()])
    sets = stored.where(wanted).groupBy("group", "bucket").agg(F.bit_or("bits").alias("bits"))
    for number, other in enumerate(others):
        sets = sets.unionByName(other.select(F.lit(f"other {number}").alias("group"), "bucket", "bits"))
    met = sets.groupBy("bucket").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("sets"))
    # A group without a row in a bucket has none of its jobs.
    return met.where(F.col("sets") == len(chosen) + len(others)).select("bucket", "bits")


def counts(stored: DataFrame, filters: dict[str, list[str]], *others: DataFrame) -> DataFrame:
    """(group, value, count) of every option that some selected job has."""
    chosen = selected(stored, filters, *others).withColumnRenamed("bits", "among")
    options = stored.where(F.col("group") != EVERY[0]).join(chosen, "bucket")
    met = options.groupBy("group", "value").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("among")))).alias("count"))
    return met.where("count > 0")


def total(stored: DataFrame, filters: dict[str, list[str]], *others: DataFrame) -> DataFrame:
    """One row: selected jobs, and companies that have any."""
    jobs = selected(stored, filters, *others).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("jobs"))
    companies = counts(stored, filters, *others).where("group = 'company'").agg(F.count(F.lit(1)).alias("companies"))
    return jobs.crossJoin(companies)  # one row each
