"""SimHash near-duplicates by a self-join of binary tries.

A pair within the budget of k differing bits agrees on at least one of k + 1
blocks of the code.  So there are k + 1 tries, each over the code rotated to
begin with another block; each is entered at the nodes at the end of its first
block, paired with themselves, and from there pairs of nodes are followed down
together: differing bits add up, and a pair is dropped when they exceed k.
Entry nodes are spread over tasks; one with very many codes is entered at the
pairs of nodes some levels lower instead.

Defined results: null and empty texts and texts without a word have the
fingerprint zero and link like any other; repeated rows are one class; rows
whose doc_id is null get the class of their fingerprint's group; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.llm.common import settle, slices
from hirelake.llm.components import components, forest
from hirelake.llm.registry import query, table

SHINGLE = 3
SEED = 42
BUDGET = 3
# Shingles whose bits are counted at a time, within one text.
BITS_AT_ONCE = 1 << 15
# Codes of an entry node beyond which it is entered lower.
HOT_NODE = 50_000
# How many levels lower.
LOWER = 8
# Rows a task holds before it follows the tries it has complete.
TASK_ROWS = 1 << 19
# Node pairs followed at a time.
PAIRS = 1 << 18
# Pairs of nodes with up to this many pairs of codes are compared directly.
LEAF = 32


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    first, last = starts[:total].tolist(), ends[size - 1 :].tolist()
    for at in range(0, total, BITS_AT_ONCE):
        part = [digest(joined[s:e], SEED) for s, e in zip(first[at : at + BITS_AT_ONCE], last[at : at + BITS_AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [fingerprint(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns.append(pa.array(np.array(codes, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.concatenate([starts[1:], [len(keys)]])


def _products(lo1, hi1, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all codes of paired ranges; of a range with itself, each pair once."""
    n2 = hi2 - lo2
    sizes = (hi1 - lo1) * n2
    which = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = lo1[which] + offset // n2[which], lo2[which] + offset % n2[which]
    once = (lo1[which] != lo2[which]) | (i < j)
    return i[once], j[once]


def follow(
    codes: np.ndarray, pairs: tuple[np.ndarray, ...], bit: int, budget: int = BUDGET
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes that differ in at most ``budget`` bits, found below
    pairs of trie nodes.

    ``codes`` are sorted; a node is a range of them that agrees above ``bit``.
    ``pairs`` holds lo1, hi1, lo2, hi2 and the bits that differ so far.
    """
    stack = [(bit, pairs)]
    while stack:
        bit, (lo1, hi1, lo2, hi2, diff) = stack.pop()
        if len(lo1) > PAIRS:
            stack.append((bit, tuple(x[PAIRS:] for x in (lo1, hi1, lo2, hi2, diff))))
            lo1, hi1, lo2, hi2, diff = (x[:PAIRS] for x in (lo1, hi1, lo2, hi2, diff))
        leaf = (hi1 - lo1) * (hi2 - lo2) <= LEAF
        if leaf.any():
            i, j = _products(lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf])
            near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            if near.any():
                yield i[near], j[near]
        lo1, hi1, lo2, hi2, diff = (x[~leaf] for x in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1):
            continue
        above, here = np.uint64(bit + 1), np.uint64(1 << bit)
        split = lambda lo: np.searchsorted(codes, (codes[lo] >> above << above) | here)
        mid1, mid2 = split(lo1), split(lo2)
        same = lo1 == lo2
        apart = ~same
        children = [
            (lo1, mid1, lo2, mid2, diff),
            (mid1, hi1, mid2, hi2, diff),
            (lo1, mid1, mid2, hi2, diff + 1),
            tuple(x[apart] for x in (mid1, hi1, lo2, mid2, diff + 1)),
        ]
        child = tuple(np.concatenate(x) for x in zip(*children, strict=True))
        alive = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)
        alive &= (child[0] != child[2]) | (child[1] - child[0] > 1)
        if alive.any():
            stack.append((bit - 1, tuple(x[alive] for x in child)))


def _join_block(rows: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the complete entry nodes in ``rows`` (task, low, high, code,
    fp), as a forest.  ``low`` and ``high`` are the lower entry nodes that the
    rows of a hot node are split by, else both -1."""
    task, low, high, code, fp = rows
    rest = 64 - width
    starts, ends = _spans(task)
    at = np.repeat(np.arange(len(starts), dtype=np.uint64), ends - starts)
    codes = (at << np.uint64(rest)) | (code.view(np.uint64) & np.uint64((1 << rest) - 1))
    order = np.argsort(codes, kind="stable")
    codes, fp = codes[order], fp[order]
    zero = np.zeros(len(starts), np.int64)
    crossing = low[starts] != high[starts]
    within = ~crossing & (ends - starts > 1)
    roots = [(rest - 1, (starts[within], ends[within], starts[within], ends[within], zero[within]))]
    if crossing.any():
        # Both lower nodes have rows, the smaller prefix first.
        below = rest - LOWER
        lo, hi = starts[crossing], ends[crossing]
        mask = high[lo].astype(np.uint64)
        cut = np.searchsorted(codes, (codes[lo] >> np.uint64(rest) << np.uint64(rest)) | (mask << np.uint64(below)))
        differ = np.bitwise_count((low[lo] ^ high[lo]).astype(np.uint64)).astype(np.int64)
        both = (cut > lo) & (cut < hi)
        roots.append((below - 1, tuple(x[both] for x in (lo, cut, cut, hi, differ))))
    kept_a, kept_b, size = [], [], 0
    for bit, pairs in roots:
        for i, j in follow(codes, pairs, bit, budget):
            kept_a.append(fp[i])
            kept_b.append(fp[j])
            size += len(i)
            if size > 1 << 20:
                a, b = forest(np.concatenate(kept_a), np.concatenate(kept_b))
                kept_a, kept_b, size = [a], [b], 0
    if not kept_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(kept_a), np.concatenate(kept_b))


def _rotate(code: Column, by: int) -> Column:
    if by == 0:
        return code
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def links(codes: DataFrame, budget: int = BUDGET, hot: int = HOT_NODE) -> DataFrame:
    """Edges (u, v) that connect all pairs of distinct codes (column fp) with at
    most ``budget`` differing bits; edges within a task are thinned to a forest."""
    width = 64 // (budget + 1)
    turned = codes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("turn"), _rotate(F.col("fp"), r * width).alias("code")) for r in range(budget + 1)])
        ).alias("t"),
    ).select("fp", "t.*")
    turned = turned.withColumn("node", F.shiftrightunsigned("code", 64 - width))
    crowded = turned.groupBy("turn", "node").count().where(F.col("count") > hot).select("turn", "node", F.lit(True).alias("hot"))
    marked = turned.join(crowded, ["turn", "node"], "left")
    own = F.shiftrightunsigned("code", 64 - width - LOWER).bitwiseAND(F.lit((1 << LOWER) - 1))
    masks = [m for m in range(1 << LOWER) if m.bit_count() <= budget]
    nodes = F.when(
        F.col("hot"),
        F.transform(
            F.array(*[F.lit(m) for m in masks]).cast("array<bigint>"),
            lambda m: F.struct(
                F.least(F.col("own"), F.col("own").bitwiseXOR(m)).alias("low"),
                F.greatest(F.col("own"), F.col("own").bitwiseXOR(m)).alias("high"),
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))))
    entered = marked.withColumn("own", own).withColumn("pair", F.explode(nodes)).select("turn", "node", "pair.low", "pair.high", "code", "fp")
    keys = ["turn", "node", "low", "high"]
    dealt = entered.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out(data):
            a, b = _join_block(data, width, budget)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            turn, node, low, high, code, fp = (batch.column(i).to_numpy().astype(np.int64) for i in range(6))
            task = (((turn << width) | node) << (2 * LOWER + 2)) | ((low + 1) << (LOWER + 1)) | (high + 1)
            held.append(np.stack([task, low, high, code, fp]))
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                data = np.concatenate(held, axis=1)
                # The last entry node may go on in the next batch.
                cut = int(np.searchsorted(data[0], data[0][-1]))
                if cut:
                    for part in _parts(data[:, :cut], width):
                        yield out(part)
                held, rows = [data[:, cut:]], data.shape[1] - cut
        if held and rows:
            for part in _parts(np.concatenate(held, axis=1), width):
                yield out(part)

    return dealt.mapInArrow(run, "u long, v long")


def _parts(data: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Whole entry nodes, as many at a time as number within ``width`` bits."""
    starts, ends = _spans(data[0])
    most = 1 << width
    for at in range(0, len(starts), most):
        yield data[:, starts[at] : ends[min(at + most, len(starts)) - 1]]


def near_duplicates(docs: DataFrame, keep: list[str], budget: int = BUDGET, hot: int = HOT_NODE) -> DataFrame:
    """Columns ``keep`` (with doc_id), fp and component_id, the least doc_id of
    the documents reachable by links."""
    marked = settle(fingerprints(docs, keep))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes.select("fp"), budget, hot))
    rooted = classes.join(joined.withColumnsRenamed({"node": "fp"}), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each group: the one of least doc_id (null ids
    last; ties: least digest of the row), with the columns of ``docs``."""
    columns = docs.columns
    digest = F.xxhash64(*[F.col(c) for c in columns])
    known = docs.withColumn("__row_digest", digest)
    grouped = near_duplicates(known, ["doc_id", "__row_digest"], budget)
    kept = grouped.groupBy("component_id").agg(
        F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "__row_digest")).alias("k")
    ).select("k.doc_id", "k.__row_digest")
    # Rows equal in every column stand for one document.
    whole = known.join(kept, (known["doc_id"].eqNullSafe(kept["doc_id"])) & (known["__row_digest"] == kept["__row_digest"]), "left_semi")
    rest = [c for c in columns if c != "doc_id"]
    return whole.groupBy("doc_id", "__row_digest").agg(*[F.first(c).alias(c) for c in rest]).select(*columns)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate group."""
    found = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
