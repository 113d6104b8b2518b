"""Training corpus from ``documents``: the stages in order, each reading what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm import langid
from hirelake.llm.bpe import encode_documents
from hirelake.llm.common import shared_folder
from hirelake.llm.decontaminate import decontaminate
from hirelake.llm.line_dedup import dedup_lines
from hirelake.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell; the others go."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier documents hold.
    Those that lose all their text go; ``n_chars`` follows the text."""
    out = dedup_lines(docs).where(~F.col("__changed") | F.col("text").rlike(r"\S"))
    return out.withColumn(
        "n_chars", F.when(F.col("__changed"), F.length("text")).otherwise(F.col("n_chars")).cast("long")
    ).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what remains, with the digests of the round trip."""
    return encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

# Compression, patience alignment and BPE merges cannot be expressed in SQL;
# tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a Parquet table in the
    folder named by ``spark.checkpoint.dir``, and goes when the next one is there."""
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
