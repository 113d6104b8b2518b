"""Helpers shared by the operators: lineage cuts and text batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows are handed to Python code in slices whose texts hold about this much.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only where the
    session names none and runs in a single process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="hirelake-checkpoint-")
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``SLICE_BYTES`` at most
    (or one row, however long): per-slice Python objects stay bounded."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * SLICE_BYTES / max(1, batch.nbytes))))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
