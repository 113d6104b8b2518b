"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and everything but letters and digits becomes one blank.
A document region within k edits of an item of m characters shares at least
m - q + 1 - k q of the item's q-grams, all on diagonals at most k apart.  Shared
q-grams are counted in overlapping bands of 2 (k + 1) diagonals, so that one
band holds them all; bands that reach the bound are kept and verified by an
alignment restricted to the band.  Nothing within the budget is missed.

The benchmark is sent to the executors in slices of a bounded number of
characters; every document meets every slice.

Defined results: null and empty documents match nothing; items with fewer than
``q`` characters after normalising match nothing; repeated items and documents
are each reported; an empty table on either side gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm.common import slices
from hirelake.llm.registry import query, table

Q = 10
# Edits allowed, as a share of the item's characters.
EDITS = 0.08
# Characters of the benchmark that are searched for at a time.
SLICE_CHARS = 4_000_000

_SPLIT = re.compile(r"[\W_]+")
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 20
_FAR = np.int32(1 << 20)


def normalise(text: str | None) -> str:
    return _SPLIT.sub(" ", (text or "").lower()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit key of each q-gram; equal q-grams have equal keys.  Characters
    count by one byte each, and others that share it are told apart only when
    a region is verified."""
    byte = (points ^ (points >> 8)).astype(np.uint8)
    n = len(byte) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((n,), "<u8", byte, strides=(1,))
    two = np.ndarray((n,), "<u2", byte, offset=8, strides=(1,))
    return eight * _ODD + two * _ODD2


def budget(m: int, edits: float = EDITS) -> int:
    """Edits allowed for an item of m characters: the share asked for, but so
    few that a match must share a q-gram."""
    return max(0, min(int(edits * m), (m - Q) // Q))


@dataclass
class Index:
    """The q-grams of some items, and the items."""

    ids: list
    points: list[np.ndarray]
    edits: np.ndarray  # per item
    bound: np.ndarray  # q-grams that a match shares, per item
    present: np.ndarray  # by the top bits of a key
    keys: np.ndarray
    begin: np.ndarray  # per key, where its occurrences begin
    item: np.ndarray  # per occurrence
    place: np.ndarray

    @staticmethod
    def build(items: Sequence[tuple], edits: float = EDITS) -> Index:
        kept = [(i, p) for i, p in ((i, _points(normalise(t))) for i, t in items) if len(p) >= Q]
        points = [p for _, p in kept]
        grams = [_grams(p) for p in points]
        key = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        size = np.array([len(p) for p in points], np.int64)
        k = np.array([budget(m, edits) for m in size.tolist()], np.int64)
        present = np.zeros(1 << _BITS, bool)
        present[keys >> np.uint64(64 - _BITS)] = True
        return Index(
            [i for i, _ in kept], points, k, size - Q + 1 - k * Q, present, keys,
            np.append(begin, len(key)), item[order], place[order],
        )

    def regions(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that reach their bound."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        gram = _grams(points)
        at = np.flatnonzero(self.present[gram >> np.uint64(64 - _BITS)])
        if not len(at):
            return nothing
        found = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
        real = self.keys[found] == gram[at]
        at, found = at[real], found[real]
        if not len(at):
            return nothing
        many = self.begin[found + 1] - self.begin[found]
        which = np.repeat(np.arange(len(at)), many)
        row = self.begin[found][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        item = self.item[row]
        diagonal = at[which] - self.place[row]
        width = self.edits[item] + 1
        band = np.floor_divide(diagonal, width)
        # A diagonal lies in the band it begins and in the one before.
        code = (np.concatenate([item, item]) << 40) + (np.concatenate([band, band - 1]) + (1 << 39))
        code, count = np.unique(code, return_counts=True)
        item = code >> 40
        enough = count >= self.bound[item]
        item = item[enough]
        return item, ((code[enough] & ((1 << 40) - 1)) - (1 << 39)) * (self.edits[item] + 1)


def align(patterns: list[np.ndarray], texts: list[np.ndarray], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern against a part of its text whose
    alignment stays on the diagonals first ... first + width - 1, and where
    that part ends."""
    size = np.array([len(p) for p in patterns])
    longest = int(size.max())
    p = np.full((len(patterns), longest), 0xFFFFFFFE, np.uint32)
    t = np.full((len(patterns), longest + width), 0xFFFFFFFF, np.uint32)
    for row, (pattern, text, d) in enumerate(zip(patterns, texts, first.tolist(), strict=True)):
        p[row, : len(pattern)] = pattern
        part = text[max(0, d) : max(0, d + longest + width)]
        t[row, max(0, -d) : max(0, -d) + len(part)] = part[: longest + width - max(0, -d)]
    steps = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(patterns), width), np.int32)
    for j in range(longest):
        new = cost + (p[:, j : j + 1] != t[:, j : j + width])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        cost = np.where((j < size)[:, None], new, cost)
    best = cost.argmin(axis=1)
    return cost[np.arange(len(best)), best], size + first + best


def find(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, the fewest
    edits, and the end of that place in the normalised text."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // slice_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    schema = docs.select("doc_id").schema.add("item_id", "long").add("edits", "integer").add("end", "integer")

    def search(number: int) -> DataFrame:
        # At most about slice_chars characters come to the driver at a time.
        own = [(r.item_id, r.text) for r in items.where(part == number).collect()]
        sent = spark.sparkContext.broadcast(Index.build(own, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches):
                where, items_, first, texts = [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    points = _points(normalise(text))
                    item, diagonal = index.regions(points)
                    where += [row] * len(item)
                    items_ += item.tolist()
                    first += diagonal.tolist()
                    texts += [points] * len(item)
                if not where:
                    continue
                rows: dict[tuple[int, int], tuple[int, int]] = {}
                for at in range(0, len(where), 512):
                    now = slice(at, at + 512)
                    width = 2 * (int(index.edits[items_[now]].max()) + 1)
                    cost, end = align([index.points[i] for i in items_[now]], texts[now], np.array(first[now]), width)
                    for row, item, c, e in zip(where[now], items_[now], cost.tolist(), end.tolist(), strict=True):
                        if c <= index.edits[item]:
                            rows[row, item] = min(rows.get((row, item), (c, e)), (c, e))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([r for r, _ in rows])),
                            pa.array([index.ids[i] for _, i in rows], pa.int64()),
                            pa.array([c for c, _ in rows.values()], pa.int32()),
                            pa.array([e for _, e in rows.values()], pa.int32()),
                        ],
                        names=schema.names,
                    )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.union, [search(number) for number in range(count)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents in which no item is found; a document whose id is null
    stays if its text has none."""
    # Found ids are few, but a copied item may be in any share of the documents.
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = find(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark, edits)
    return keyed.join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
