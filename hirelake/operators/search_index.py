"""A stored index for text and place search.

Jobs get numbers, and a segment holds the jobs of SEGMENT numbers in a row.  For
every pair and triple of neighbouring characters (a gram) the index has, block by
block of BLOCK numbers, a bit for each job, set if its texts hold it.  A search intersects
the bits of its words' grams, which leaves few candidates, reads the segments that have
any, and verifies them with the conditions of ``search``.

A text that several jobs of a block share, such as a title, is cut into grams once.

A day's changes are added: a changed job gets a new number in a new segment, its old
number is gone, and nothing that is stored is rewritten but the buckets of the job ids
concerned.  A generation lists what belongs together; what an interrupted update
has left is not in it.

A word of one character, and no word at all, read all segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.operators.search import place_matches, place_labels, text_matches
from hirelake.sources.buckets import BucketedTable

SEGMENT = 8192
GRAMS = (2, 3)
# The bits of a block, in words of 64.
WORDS = ("w0", "w1", "w2", "w3")
BLOCK = 64 * len(WORDS)
# Kinds of grams: of any searched text, of places.
TEXT, PLACE = "t", "p"
_GENERATION = "segment bigint, jobs bigint, bytes bigint, grams_version bigint, numbers_version bigint"


def grams(texts: Column) -> Column:
    """The distinct grams of a text, lower-cased, as an array; linear in its length."""

    text = F.lower(F.coalesce(texts, F.lit("")))
    # A match is one letter; what follows it is looked at only, so the next match starts a letter later.
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))."), F.lit(1)) for size in GRAMS]
    return F.array_distinct(F.concat(*runs))


def wanted_grams(needle: str) -> list[str]:
    """The grams that a text with ``needle`` must hold, as few as tell the most."""
    text = needle.strip().lower()
    size = max((n for n in GRAMS if n <= len(text)), default=0)
    return sorted({text[i : i + size] for i in range(len(text) - size + 1)}) if size else []


def _bit(at: Column) -> Column:
    """The bit of a place in its block."""
    return F.getbit(F.element_at(F.array(*WORDS), (at / 64).cast("int") + 1), at % 64)


@dataclass(frozen=True)
class SearchIndex:
    """``path`` is a folder all executors can reach, ``name`` a prefix of table names;
    ``schema`` is the DDL list of the jobs' columns, with ``id`` bigint or string."""

    spark: SparkSession
    name: str
    path: str
    schema: str
    id_type: str = "bigint"
    segment: int = SEGMENT
    buckets: int = 64

    def _grams(self) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.name}_grams", f"{self.path}/grams", "gram string, block bigint, " + ", ".join(f"{w} bigint" for w in WORDS), ("gram",), self.buckets)

    def _numbers(self) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.name}_numbers", f"{self.path}/numbers", f"id {self.id_type}, number bigint", ("id",), self.buckets)

    def create(self) -> SearchIndex:
        self._grams().create()
        self._numbers().create()
        return self

    # ---- generations ----

    def _system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str, prefix: str) -> list[int]:
        system, place = self._system(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def generation(self) -> int:
        """The last complete generation, -1 before the first."""
        done = [n for n in self._names("generations", "generation=") if self._exists(f"generations/generation={n}/_SUCCESS")]
        return max(done, default=-1)

    def _exists(self, name: str) -> bool:
        system, place = self._system(f"{self.path}/{name}")
        return system.exists(place)

    def segments(self) -> DataFrame:
        """The segments of the last generation, with their jobs and bytes."""
        number = self.generation()
        if number < 0:
            return self.spark.createDataFrame([], _GENERATION)
        return self.spark.read.schema(_GENERATION).parquet(f"{self.path}/generations/generation={number}")

    def _versions(self) -> tuple[int | None, int | None]:
        row = self.segments().agg(F.max("grams_version").alias("g"), F.max("numbers_version").alias("n")).first()
        return row["g"], row["n"]

    # ---- writing ----

    def update(self, jobs: DataFrame, removed: DataFrame | None = None, cut=lambda df: df) -> None:
        """Add new and changed ``jobs`` (one row an id), and take out ``removed`` ids.

        ``cut`` (``session.cut_lineage``) must settle what it is given: numbers follow
        the partitions of the settled rows."""
        spark = self.spark
        grams_version, numbers_version = self._versions()
        # Numbers of an interrupted update are not used again.
        first = max([-1, *self._names("jobs", "segment=")]) + 1
        columns = [c for c in jobs.columns if c != "id"]
        rows = cut(jobs.select("id", *columns))
        placed = rows.select(
            F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"), "*"
        )
        # One count a partition.
        counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
        offsets, at = {}, first * self.segment
        for part in sorted(counts):
            offsets[part], at = at, at + counts[part]
        if counts:
            offset = F.element_at(F.create_map(*[F.lit(x) for part, n in offsets.items() for x in (part, n)]), F.col("_part"))
            numbered = placed.withColumn("number", offset.cast("bigint") + F.col("_row")).drop("_part", "_row")
        else:
            numbered = placed.withColumn("number", F.lit(None).cast("bigint")).drop("_part", "_row")
        numbered = numbered.withColumn("segment", F.expr(f"number div {self.segment}")).withColumn("place", F.expr(f"int(number % {self.segment})"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{self.path}/jobs")
        # What follows reads the columns it needs of the rows as they were stored.
        stored = self._stored().where(F.col("segment") >= first)
        numbers = cut(stored.select("id", "number", "segment"))
        lists = self._lists(stored)
        grams_version = self._grams().append(lists, grams_version)
        gone_ids = numbers.select("id") if removed is None else numbers.select("id").union(removed.select("id")).distinct()
        known = self._numbers().read(numbers_version)
        number = self.generation() + 1
        gone = cut(known.join(gone_ids, "id", "left_semi").select("number"))
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/generation={number}")
        changes = cut(gone_ids.join(numbers.select("id", "number"), "id", "left"))
        numbers_version = self._numbers().rewrite(
            changes, lambda rows, new: rows.join(new.select("id"), "id", "left_anti").unionByName(new.where("number IS NOT NULL")), numbers_version
        )
        sizes = numbers.groupBy("segment").agg(F.count(F.lit(1)).alias("jobs"))
        sizes = [(r["segment"], r["jobs"], self._bytes(r["segment"]), grams_version, numbers_version) for r in sizes.collect()]
        before = [(s, j, b, grams_version, numbers_version) for s, j, b, _, _ in map(tuple, self.segments().collect())]
        spark.createDataFrame(sorted(before + sizes) or [], _GENERATION).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/generations/generation={number}"
        )

    def _lists(self, numbered: DataFrame) -> DataFrame:
        """One row a gram and block, with the bits of the jobs that hold it."""

        def bits(value) -> list[Column]:
            return [F.bit_or(value(i, w)).alias(w) for i, w in enumerate(WORDS)]

        texts = [F.array("title", "company", "description", "job_family", "job_subfamily")]
        texts += [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("skills", "related_roles")]
        # Places first: the position of a text tells its kind.
        jobs = numbered.select("number", place_labels().alias("places"), F.concat(*texts).alias("texts"))
        number = F.col("number")
        # A block lies in one partition from here on, so both aggregates take place where it is.
        jobs = jobs.select(F.expr(f"number div {BLOCK}").alias("block"), (number % BLOCK).cast("int").alias("at"), "places", "texts").repartition("block")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 64)
        shared = (
            jobs.select("block", F.expr("at div 64").alias("word"), bit.alias("bit"), F.size("places").alias("first"), F.posexplode(F.concat("places", "texts")).alias("pos", "text"))
            .where("text IS NOT NULL")
            .withColumn("kind", F.when(F.col("pos") < F.col("first"), PLACE).otherwise(TEXT))
            .groupBy("block", "kind", "text")
            .agg(*bits(lambda i, _: F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("bigint"))))
        )
        cut = shared.select("block", "kind", F.explode(grams(F.col("text"))).alias("gram"), *WORDS)
        return cut.select("block", F.concat("kind", "gram").alias("gram"), *WORDS).groupBy("block", "gram").agg(*bits(lambda _, w: F.col(w)))

    def _bytes(self, segment: int) -> int:
        system, place = self._system(f"{self.path}/jobs/segment={segment}")
        return system.getContentSummary(place).getLength()

    # ---- searching ----

    def _committed(self) -> list[int]:
        """One number for each SEGMENT jobs ever written."""
        return [r["segment"] for r in self.segments().select("segment").collect()]

    def _stored(self) -> DataFrame:
        """All jobs ever written, also by interrupted updates."""
        schema = f"{self.schema}, number bigint, place int, segment bigint"
        if not self._names("jobs", "segment="):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/jobs")

    def jobs(self, segments: list[int] | None = None) -> DataFrame:
        """The jobs of the last generation, with segment, place and number; of some segments or all."""
        if self.generation() < 0:
            return self._stored()
        committed = self._committed()
        chosen = committed if segments is None else sorted(set(segments) & set(committed))
        rows = self._stored().where(F.col("segment").isin(chosen))
        gone = self.spark.read.schema("number bigint, generation int").parquet(f"{self.path}/gone")
        return rows.join(gone.where(F.col("generation") <= self.generation()), "number", "left_anti")

    def _met(self, query: str, place: str) -> DataFrame | None:
        """The blocks, and in them the bits of jobs, that hold every gram wanted; None if no gram is."""
        wanted = [TEXT + g for g in wanted_grams(query)] + [PLACE + g for g in wanted_grams(place)]
        if not wanted:
            return None
        rows = self._grams().read(self._versions()[0]).where(F.col("gram").isin(wanted))
        # Updates may have met in a block.
        one = rows.groupBy("gram", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])
        both = one.groupBy("block").agg(F.count(F.lit(1)).alias("held"), *[F.bit_and(w).alias(w) for w in WORDS])
        return both.where((F.col("held") == len(wanted)) & F.expr(f"{' | '.join(WORDS)} <> 0")).drop("held")

    def candidates(self, query: str = "", place: str = "") -> DataFrame | None:
        """(segment, place) of jobs that hold every gram wanted; None if no gram is."""
        met = self._met(query, place)
        if met is None:
            return None
        at = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: _bit(i) == 1)
        numbers = met.select("block", F.explode(at).alias("at")).selectExpr(f"block * {BLOCK} + at AS number")
        return numbers.selectExpr(f"number div {self.segment} AS segment", f"int(number % {self.segment}) AS place")

    def search(self, query: str = "", place: str = "") -> DataFrame:
        """The jobs that ``search.search`` finds for a text and a place."""
        met = self._met(query, place)
        if met is None:
            rows = self.jobs()
        else:
            # Segments without a candidate are not read.
            rows = self.jobs([r["segment"] for r in self.candidates(query, place).select("segment").distinct().collect()])
            rows = rows.withColumn("block", F.expr(f"number div {BLOCK}")).join(met, "block").where(_bit((F.col("number") % BLOCK).cast("int")) == 1).drop("block", *WORDS)
        if query.strip():
            rows = rows.where(text_matches(query))
        if place.strip():
            rows = rows.where(place_matches(place))
        return rows.drop("segment", "place", "number")

    def cost(self, query: str = "", place: str = "") -> DataFrame:
        """One row: candidates, segments and bytes of jobs that a search reads, and all there are."""
        found = self.candidates(query, place)
        every = self.segments()
        if found is None:
            found = self.jobs().select("segment", "place")
        read = found.groupBy("segment").agg(F.count(F.lit(1)).alias("candidates"))
        return every.join(read, "segment", "left").agg(
            F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), F.count("candidates").alias("segments_read"), F.count(F.lit(1)).alias("segments"),
            F.coalesce(F.sum(F.when(F.col("candidates").isNotNull(), F.col("bytes"))), F.lit(0)).alias("bytes_read"), F.sum("bytes").alias("bytes"),
        )
