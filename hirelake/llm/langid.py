"""Language identification by compression.

A language is a raw-content zstandard dictionary made of sample texts.  A text
is cut into blocks, each block is compressed with every dictionary, and the
language of the least total size wins.  A text is rejected where the best two
sizes are too close.

Words are letters only, lower-cased; a word repeated at once counts once, so
that runs of one word, which any dictionary compresses, do not drown the rest.

The dictionaries are fitted on a bounded sample: per language the
``SAMPLE_ROWS`` labelled texts of least digest of id and text, ``SAMPLE_CHARS``
characters of each, ``DICTIONARY_BYTES`` in all.  Predictions read whole texts.

Defined results: a null text and one without a letter are ``und`` with score 0,
rejected; ties go to the language that sorts first and are rejected; with no
labelled row every text is ``und``; rows without an id are never held out and
never learned from; repeated rows are learned from once and predicted alike; an empty
table gives an empty result; numerals of any script are no letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hirelake.llm.common import slices
from hirelake.llm.registry import query, table

SAMPLE_ROWS = 1000
SAMPLE_CHARS = 1000
DICTIONARY_BYTES = 256 << 10
BLOCK_BYTES = 4096
LEVEL = 3
# A text is rejected if its best size is within this share of the second best.
MARGIN = 0.002
UNKNOWN = "und"
# Every FOLDS-th document (by a checksum of its id) is held out of the sample.
FOLDS = 5

_words = re.compile(r"[^\W\d_]+").findall
# Signs such as fractions and raised digits are alphanumeric and neither letters nor digits.
_numerals = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
# Apart for the basic plane, whose set is looked up at once; the others are rare.
_numeral = re.compile(f"[{''.join(c for c in _numerals if c <= '\uffff')}]")
_beyond = re.compile("[\U00010000-\U0010ffff]").search
_numeral_beyond = re.compile(f"[{''.join(c for c in _numerals if c > '\uffff')}]")


def letters(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        low = _numeral.sub(" ", low)
        if _beyond(low):
            low = _numeral_beyond.sub(" ", low)
    return " ".join(word for word, _ in groupby(_words(low))).encode("utf-8", "replace")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from documents that are not held out.
    At most SAMPLE_ROWS * SAMPLE_CHARS characters a language come to the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    pick = Window.partitionBy("lang").orderBy("at", "sample")
    marked = labelled.select("lang", F.xxhash64("doc_id", "text").alias("at"), "text")
    # Digests of different rows are even: those beyond twice the share that is wanted go before the ranking.
    counts = {r.lang: r.n for r in marked.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, (2.0 * SAMPLE_ROWS / max(n, 1) - 0.5) * 2.0**64)])
    sample = (
        marked.where(F.col("at") <= F.element_at(bound, F.col("lang")))
        .groupBy("lang", "at")
        .agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("sample"))
        .withColumn("place", F.row_number().over(pick))
        .where(F.col("place") <= SAMPLE_ROWS)
    )
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.collect():
        texts.setdefault(row.lang, []).append((row.place, letters(row.sample)))
    return {
        lang: b"\n".join(text for _, text in sorted(own))[:DICTIONARY_BYTES] or b" " for lang, own in sorted(texts.items())
    }


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by_language = {
            lang: zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            ).compress
            for lang, content in dictionaries.items()
        }

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin (0 to 1) of a whole text."""
        data = letters(text or "")
        if not data or not self.by_language:
            return UNKNOWN, 0.0
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(len(b) for b in map(compress, blocks)), lang) for lang, compress in self.by_language.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], margin: float = MARGIN) -> DataFrame:
    """Columns ``keep``, lang_pred, score and accepted.  Only the text is an
    input of a prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value).predict
        for batch in slices(batches):
            found = [classify(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))] + [
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
                pa.array([lang != UNKNOWN and score >= margin for lang, score in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents whose language is told, with their columns."""
    # Carried whole under one name, so that no column's name can clash.
    every = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    carried = docs.select(F.struct(*every).alias("row"), "text")
    return predict(carried, dictionaries, ["row"], margin).where("accepted").select("row.*")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, fit(docs), ["doc_id", "held_out"])
