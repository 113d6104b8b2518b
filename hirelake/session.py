"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All calendar arithmetic is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Big-to-big joins rely on run-time splitting of hot partitions, even when
    # that costs one more exchange afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Day-partitioned outputs replace only the days they contain.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume; safe to call repeatedly."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    ``fallback`` is used only where the cluster names none (unit tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own tables, below the shared one.  It is
    removed when the session's program ends."""
    folder = f"{shared_dir(spark, spark.sparkContext.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(_quietly, remove)
    return folder


def _quietly(action) -> None:
    try:
        action()
    except Exception:  # the JVM has ended first; nothing can be removed through it
        pass


def cut_lineage(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Reliable checkpoint of a result that several outputs are derived from."""
    spark = df.sparkSession
    folder = shared_dir(spark, fallback)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
