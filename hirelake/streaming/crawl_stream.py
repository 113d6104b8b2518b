"""Structured Streaming over finished crawls and lifecycle events.

A crawl is a row of the manifest, not a file: its postings may lie in any
number of files, come before or after that row, and come twice; a crawl that
failed or found nothing has a row as well.  Manifest and postings are one keyed
stream.  The state of a crawl holds the places that have arrived and their
postings, and hands them on once all that the manifest counts are there; a timer
gives up a crawl that stays incomplete.  So a batch costs what is new in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hirelake.operators import lifecycle
from hirelake.operators.lifecycle import JOB_SCHEMA, QUEUE_SCHEMA, SOURCE_SCHEMA
from hirelake.sources.buckets import BucketedTable
from hirelake.sources.store import absent, first_per_key, read_rows

MANIFEST_SCHEMA = (
    "crawl_run_id bigint, source_id bigint, status string, started_at timestamp, finished_at timestamp, "
    "job_count bigint, error string"
)
POSTING_SCHEMA = (
    "source_id bigint, crawl_run_id bigint, pos bigint, external_job_id string, "
    "provider string, company_id string, company string, title string, location string, employment_type string, "
    "workplace_type string, posted_at timestamp, posted_at_source string, description_text string, "
    "description_html string, job_url string, apply_url string, raw_payload string, content_hash string"
)
WAITING_SCHEMA = f"{MANIFEST_SCHEMA}, settled boolean"
LEDGER_SCHEMA = "name string, part int, version bigint"
# What the state of a crawl hands on: its manifest row as it stands, or a posting.
ARRIVAL_SCHEMA = "crawl_run_id bigint, kind string, arrived bigint, body string"
# Parts that the state is kept in, by a hash of the source.
PARTS = 64
STATE = {"jobs": JOB_SCHEMA, "sources": SOURCE_SCHEMA, "queue": f"{QUEUE_SCHEMA}, source_id bigint"}
# Rows that the state of a crawl hands on at a time.
HANDED_ON = 10_000
# Instants in state bodies keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


@dataclass(frozen=True)
class Folders:
    """Where a stream reads and writes; all folders are shared by the executors."""

    manifest: str
    postings: str
    sources: str  # the sources before the first crawl
    root: str

    def at(self, *names: object) -> str:
        return "/".join([self.root, *map(str, names)])


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, place = _place(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


# ---- completeness: one state a crawl ----


class Arrivals(StatefulProcessor):
    """Collects a crawl until it is complete, and settles it once.

    Handed on are: ``listed``, when a manifest row of an incomplete crawl comes;
    ``ready`` with all postings; ``overfull``, when more places arrive than the
    crawl counts; ``abandoned``, when it is incomplete ``patience`` after its manifest
    row came.  What comes after that is left out.  Of two manifest rows of a crawl
    the one that finished later counts, of two postings of a place the first.
    """

    def __init__(self, patience: float, remembered: float):
        self.patience = int(patience * 1000)
        self.remembered = int(remembered * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.manifest = handle.getValueState("manifest", "body string")
        self.places = handle.getValueState("places", "packed binary")
        self.postings = handle.getListState("postings", "body string")
        self.settled = handle.getValueState("settled", "kind string", self.remembered)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.settled.exists():
            return
        listed = self._arrived(rows)
        if not self.manifest.exists():
            return
        (body,) = self.manifest.get()
        manifest = json.loads(body)
        count = len(self._known())
        wanted = manifest.get("job_count") or 0
        if manifest.get("status") != "success" or count == wanted:
            yield from self._settle(key, "ready", body, count)
        elif count > wanted:
            yield from self._settle(key, "overfull", body, count)
        elif listed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
            yield self._handed(key, "listed", count, [body])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.settled.exists() and self.manifest.exists():
            yield from self._settle(key, "abandoned", self.manifest.get()[0], len(self._known()))

    def close(self) -> None:
        pass

    def _known(self) -> np.ndarray:
        return np.frombuffer(self.places.get()[0], np.int64) if self.places.exists() else np.empty(0, np.int64)

    def _arrived(self, rows: Iterator[pd.DataFrame]) -> bool:
        """Take in rows of one batch; was there a manifest row that counts?"""
        known, fresh, listed = self._known(), [], False
        for part in rows:
            for body in part.loc[part["pos"].isna(), "body"]:
                old = json.loads(self.manifest.get()[0]) if self.manifest.exists() else None
                new = json.loads(body)
                rank = [(m.get("finished_at") or "", m.get("status") or "") for m in (old or {}, new)]
                if old is None or rank[0] < rank[1]:
                    self.manifest.update((body,))
                    listed = True
            found = part[part["pos"].notna()].drop_duplicates("pos")
            place = found["pos"].to_numpy(np.int64)
            new_here = ~np.isin(place, known)
            if new_here.any():
                self.postings.appendList([(b,) for b in found.loc[new_here, "body"]])
                fresh.append(place[new_here])
                known = np.concatenate([known, fresh[-1]])
        if fresh:
            self.places.update((np.sort(known).tobytes(),))
        return listed

    def _settle(self, key, kind: str, body: str, count: int) -> Iterator[pd.DataFrame]:
        self.settled.update((kind,))
        yield self._handed(key, kind, count, [body])
        if kind == "ready" and json.loads(body).get("status") == "success" and self.postings.exists():
            held: list[str] = []
            for (posting,) in self.postings.get():
                held.append(posting)
                if len(held) == HANDED_ON:
                    yield self._handed(key, "posting", count, held)
                    held = []
            if held:
                yield self._handed(key, "posting", count, held)
        for state in (self.manifest, self.places, self.postings):
            state.clear()

    def _handed(self, key, kind: str, count: int, bodies: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"crawl_run_id": key[0], "kind": kind, "arrived": count, "body": bodies})


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def settled_crawls(
    manifest: DataFrame, postings: DataFrame, patience: float = 86_400, remembered: float = 90 * 86_400
) -> DataFrame:
    """ARRIVAL_SCHEMA rows of two streams, keyed by crawl; rows without a crawl are
    left out, and postings without a place.  ``patience`` and ``remembered`` (how long
    a settled crawl's late rows are known as such) are in seconds."""
    body = F.to_json(F.struct(*_columns(MANIFEST_SCHEMA)), _TIMES)
    rows = manifest.select("crawl_run_id", F.lit(None).cast("bigint").alias("pos"), body.alias("body")).union(
        postings.where("pos IS NOT NULL").select(
            "crawl_run_id", "pos", F.to_json(F.struct(*_columns(POSTING_SCHEMA)), _TIMES).alias("body")
        )
    )
    return (
        rows.where("crawl_run_id IS NOT NULL")
        .groupBy("crawl_run_id")
        .transformWithStateInPandas(Arrivals(patience, remembered), ARRIVAL_SCHEMA, "Append", "ProcessingTime")
    )


# ---- application: the crawls of a batch in the order of their sources ----


def _ledger(spark: SparkSession, folders: Folders, batch_id: int) -> set[tuple[str, int, int]]:
    """(table, part, version) after a batch: at most PARTS rows a table."""
    if batch_id < 0:
        return set()
    rows = read_rows(spark, folders.at("ledger", f"batch={batch_id}"), LEDGER_SCHEMA).collect()
    return {(r.name, r.part, r.version) for r in rows}


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(parts)).cast("int")


def _manifests(arrivals: DataFrame) -> DataFrame:
    """Manifest rows as handed on; what did not complete has failed."""
    row = F.from_json("body", MANIFEST_SCHEMA, _TIMES)
    named = arrivals.where("kind <> 'posting'").select("kind", "arrived", row.alias("row")).select("kind", "arrived", "row.*")
    counted = F.concat(F.col("arrived"), F.lit(" of "), F.coalesce("job_count", F.lit(0)), F.lit(" postings arrived"))
    return named.withColumns(
        {
            "status": F.when(F.col("kind").isin("overfull", "abandoned"), "failed").otherwise(F.col("status")),
            "error": F.when(F.col("kind").isin("overfull", "abandoned"), counted).otherwise(F.col("error")),
            "settled": F.col("kind") != "listed",
        }
    ).select(*_columns(WAITING_SCHEMA))


def _in_order(rows: DataFrame, sources: DataFrame, parts: int) -> DataFrame:
    """Crawls not applied yet, with _ready, _late, _round and part.

    A source's later crawls wait for its earlier ones.  A crawl that began no later
    than one already applied is late: it would undo what is known.
    """
    latest = first_per_key(rows, ["crawl_run_id"], [F.col("settled").cast("int"), F.col("finished_at")], last=True)
    applied = sources.select("source_id", F.col("last_attempt_at").alias("_applied"))
    known = latest.join(applied, "source_id", "left").withColumn(
        "_late", F.coalesce(F.col("started_at") <= F.col("_applied"), F.lit(False))
    )
    order = Window.partitionBy("source_id", "_late").orderBy("started_at", "crawl_run_id")
    return (
        known.withColumn("_ready", (F.min(F.col("settled").cast("int")).over(order) == 1) | F.col("_late"))
        .withColumn("_round", F.row_number().over(order))
        .withColumn("part", _part(parts))
        .drop("_applied")
    )


def lifecycle_writer(
    folders: Folders,
    cut,
    parts: int = PARTS,
    schema_version: str = "v3",
    window_days: int = 1,
    min_previous: int = 20,
    min_ratio: float = 0.25,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: apply the crawls that a micro-batch hands on.

    Batch n is computed from the ledger of batch n-1 and writes folders of its
    own before its ledger, so a batch that is replayed after a lost driver
    writes the same again.  Only parts whose sources were crawled are read and
    rewritten; what the ledger before last named and the last one did not is removed.
    Crawls that wait for an earlier one are carried from batch to batch with their
    postings.  ``cut`` (``session.cut_lineage``) settles what several outputs are derived from.
    """

    def carried(spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(folders.at(name, f"batch={batch_id - 1}"))

    def apply(arrivals: DataFrame, batch_id: int) -> None:
        spark = arrivals.sparkSession
        arrivals = cut(arrivals)
        ledger = _ledger(spark, folders, batch_id - 1)
        rows = _manifests(arrivals).unionByName(carried(spark, "waiting", WAITING_SCHEMA, batch_id)).withColumn("part", _part(parts))
        touched = sorted(r.part for r in rows.select("part").distinct().collect())
        known = {(name, part): version for name, part, version in ledger}

        def state(name: str) -> DataFrame:
            paths = [folders.at(name, f"v={known[name, p]}", f"part={p}") for p in touched if (name, p) in known]
            return spark.read.schema(STATE[name]).parquet(*paths) if paths else spark.createDataFrame([], STATE[name])

        sources = state("sources")
        if not all(("sources", p) in known for p in touched):
            first = spark.read.parquet(folders.sources).where(_part(parts).isin([p for p in touched if ("sources", p) not in known]))
            sources = sources.unionByName(first, allowMissingColumns=True).select(*sources.columns)
        listed = cut(_in_order(rows.drop("part"), sources, parts))
        ready = listed.where("_ready AND NOT _late")
        postings = arrivals.where("kind = 'posting'").select(F.from_json("body", POSTING_SCHEMA, _TIMES).alias("row")).select("row.*")
        postings = postings.unionByName(carried(spark, "held", POSTING_SCHEMA, batch_id))
        waiting = listed.where("NOT _ready")
        waiting.select(*_columns(WAITING_SCHEMA)).write.mode("overwrite").parquet(folders.at("waiting", f"batch={batch_id}"))
        postings.join(waiting.select("crawl_run_id"), "crawl_run_id", "left_semi").select(*_columns(POSTING_SCHEMA)).write.mode(
            "overwrite"
        ).parquet(folders.at("held", f"batch={batch_id}"))

        jobs, as_of = state("jobs"), F.col("started_at")
        history: dict[str, list[DataFrame]] = {"events": [], "versions": [], "queue": [], "crawl_runs": []}
        late = listed.where("_late").withColumns({"succeeded": F.lit(False), "anomaly": F.lit(None).cast("string"),
            "error": F.lit("a later crawl of the source was applied before")})
        history["crawl_runs"].append(lifecycle.crawl_run_rows(late, as_of))
        counted = postings.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("job_count"))
        folded = cut(lifecycle.fold_crawls(ready.select("source_id", "crawl_run_id", "started_at", "status", "error"), counted, sources, min_previous, min_ratio))
        sources = folded.drop("decisions")
        decided = folded.select(F.posexplode("decisions").alias("_round", "decision")).select("_round", "decision.*")
        history["crawl_runs"].append(lifecycle.crawl_run_rows(decided, as_of))
        rounds = folded.agg(F.max(F.size("decisions"))).first()[0] or 0
        no_queue = spark.createDataFrame([], QUEUE_SCHEMA)
        # Most batches hold one crawl of a source; what each round leaves is read by the next.
        for number in range(rounds):
            decisions = decided.where(F.col("_round") == number).drop("_round")
            wanted = decisions.where("succeeded").select("crawl_run_id")
            batch = postings.join(wanted, "crawl_run_id", "left_semi").drop("crawl_run_id")
            # Each source's rows are dated by its own crawl.
            changes = cut(lifecycle.with_outcome(lifecycle.diff(jobs, batch, decisions), as_of, window_days))
            jobs = lifecycle.next_state(changes, as_of)
            history["events"].append(lifecycle.lifecycle_events(changes, as_of))
            history["versions"].append(lifecycle.superseded_versions(changes, as_of))
            queued = changes.where("queue_reason IS NOT NULL").select("job_id", "source_id")
            added = lifecycle.queue_entries(changes, no_queue, as_of, schema_version).join(queued, "job_id")
            history["queue"].append(added.withColumn("_round", F.lit(number)))

        def together(name: str) -> DataFrame:
            return reduce(DataFrame.unionByName, history[name])

        current = dict(known)
        if rounds:
            queue = state("queue")
            added = first_per_key(together("queue"), ["queue_id"], [F.col("_round")]).drop("_round")
            added = cut(absent(added, queue, ["queue_id"]))
            history["queue"] = [added]
            for name, table in (("jobs", jobs), ("sources", sources), ("queue", queue.unionByName(added, allowMissingColumns=True))):
                place = folders.at(name, f"v={batch_id}")
                dealt = table.withColumn("part", _part(parts))
                dealt.write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", "static").parquet(place)
                written = [int(n.removeprefix("part=")) for n in _names(spark, place) if n.startswith("part=")]
                current = {k: v for k, v in current.items() if k[0] != name or k[1] not in touched}
                current |= {(name, p): batch_id for p in written}
        for name, tables in history.items():
            if tables:
                together(name).write.mode("overwrite").parquet(folders.at(name + "_history" if name == "queue" else name, f"batch={batch_id}"))
        rows = sorted((name, part, version) for (name, part), version in current.items())
        spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(folders.at("ledger", f"batch={batch_id}"))
        # What was replaced by the batch before is no longer read, not even by a replay.
        for name, part, version in _ledger(spark, folders, batch_id - 2) - ledger:
            _remove(spark, folders.at(name, f"v={version}", f"part={part}"))
        for name in ("waiting", "held"):
            _remove(spark, folders.at(name, f"batch={batch_id - 2}"))

    return apply


def start_lifecycle(
    spark: SparkSession, folders: Folders, cut, patience: float = 86_400, remembered: float = 90 * 86_400, **options
) -> StreamingQuery:
    """Apply the crawls that are complete, then stop; restarts go on from the checkpoint.
    A crawl that stays incomplete is given up in the first run with new rows after its patience has ended."""
    for folder in (folders.manifest, folders.postings):
        system, place = _place(spark, folder)
        system.mkdirs(place)
    crawls = settled_crawls(
        spark.readStream.schema(MANIFEST_SCHEMA).parquet(folders.manifest),
        spark.readStream.schema(POSTING_SCHEMA).parquet(folders.postings),
        patience,
        remembered,
    )
    writer = (
        crawls.writeStream.foreachBatch(lifecycle_writer(folders, cut, **options))
        .outputMode("append")
        .option("checkpointLocation", folders.at("checkpoint"))
        .trigger(availableNow=True)
    )
    needed = {
        # The keyed state needs a store with columns.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # With timers by the clock there is always one more batch to run; only new rows start one here.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in needed}
    try:
        for key, value in needed.items():
            spark.conf.set(key, value)
        return writer.start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def last_batch(spark: SparkSession, folders: Folders) -> int:
    """Number of the last batch that was applied, -1 before the first."""
    return max((int(n.removeprefix("batch=")) for n in _names(spark, folders.at("ledger"))), default=-1)


def current_state(spark: SparkSession, folders: Folders, name: str, schema: str, batch_id: int | None = None) -> DataFrame:
    """The jobs, sources or queue after a batch, by default the last one."""
    batch_id = last_batch(spark, folders) if batch_id is None else batch_id
    places = [folders.at(n, f"v={v}", f"part={p}") for n, p, v in _ledger(spark, folders, batch_id) if n == name]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def daily_event_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events per UTC day and type, for update mode: a day is published at once
    and corrected until ``lateness`` has passed."""
    return (
        events.withWatermark("occurred_at", lateness)
        .groupBy(F.window("occurred_at", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "event_type", "n")
    )


def counts_table(spark: SparkSession, name: str, path: str, buckets: int = 16) -> BucketedTable:
    """Where ``daily_event_counts`` are kept: one row a day and type."""
    return BucketedTable(spark, name, path, "day date, event_type string, n bigint, batch bigint", ("day", "event_type"), buckets).create()


def keyed_sink(table: BucketedTable, cut) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function of a query in update mode: the newest row of each key.

    ``table`` has the keys of the rows and a column ``batch``.  A batch rewrites the buckets
    it has keys of, so what is stored is bounded by the keys, and a batch that comes
    again, even after later ones, changes nothing.
    """

    def apply(changed: DataFrame, batch_id: int) -> None:
        rows = cut(changed.withColumn("batch", F.lit(batch_id).cast("bigint")))
        if not rows.isEmpty():
            table.upsert(rows, when=lambda old, new: new("batch") >= old("batch"))

    return apply
