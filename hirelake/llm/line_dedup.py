"""Line deduplication by pairwise alignment.

Documents that share line hashes are paired, a pair is aligned by patience
diff over its lines, and blocks of consecutive aligned lines that hold enough
words are deleted from the later document (the one of larger doc_id); so are
blocks that have moved, which no one alignment can hold: a line goes if any run
of lines around it stands in an earlier document as well.  The earliest copy of
a block is never deleted.

A rare line pairs every two of its holders.  Any other line pairs each holder
with the earliest one, so that a line costs about as many pairs as it has
holders, however common it is.  So does any shortest run of such lines, blank
ones between them, that has the words of a block: a block is covered by the
shortest runs that begin or end in it, and one with a rare line pairs by that
line, so that every block meets an earlier copy of each of its lines.

Defined results: a null text has no lines; an empty or blank line has no hash
of its own to share but may lie inside a block; rows equal in doc_id and text
are one document and change alike; a null doc_id is earlier than any other; a
text may lose all its lines and is then empty; an empty table gives an empty
result; all columns of the input are returned, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm.common import settle, slices
from hirelake.llm.registry import query, table

# A line is rare if at most so many documents hold it.
RARE = 8
# Words of the shortest block that is deleted.
BLOCK_WORDS = 20

# Digests of runs: a polynomial of the line hashes modulo a prime.
_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51
# Stands for a blank line, so that leading ones count.
_BLANK = 0x0B4C1D7E52A96F35

_KEY = ["__id", "__digest"]


def _anchors(a: list[int], b: list[int], lo: int, hi: int, lo2: int, hi2: int) -> list[tuple[int, int]]:
    """Lines that occur once on either side, in the longest order they share."""
    once_a, once_b = Counter(a[lo:hi]), Counter(b[lo2:hi2])
    place = {x: j for j, x in enumerate(b[lo2:hi2], lo2) if once_b[x] == 1 and once_a.get(x) == 1}
    tops: list[int] = []
    piles: list[tuple[int, int, int]] = []  # i, j and where the pile to the left ended
    last: list[int] = []
    for i in range(lo, hi):
        j = place.get(a[i])
        if j is None:
            continue
        at = bisect_left(tops, j)
        piles.append((i, j, last[at - 1] if at else -1))
        if at == len(tops):
            tops.append(j)
            last.append(len(piles) - 1)
        else:
            tops[at], last[at] = j, len(piles) - 1
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = piles[at]
        out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line numbers of two documents, in order."""
    found = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        lo, hi, lo2, hi2 = stack.pop()
        while lo < hi and lo2 < hi2 and a[lo] == b[lo2]:
            found.append((lo, lo2))
            lo, lo2 = lo + 1, lo2 + 1
        while lo < hi and lo2 < hi2 and a[hi - 1] == b[hi2 - 1]:
            hi, hi2 = hi - 1, hi2 - 1
            found.append((hi, hi2))
        if lo == hi or lo2 == hi2:
            continue
        anchors = _anchors(a, b, lo, hi, lo2, hi2)
        if not anchors:
            continue
        # Between anchors, each range begins with its anchor.
        bounds = [(lo, lo2), *anchors, (hi, hi2)]
        stack.extend((p[0], q[0], p[1], q[1]) for p, q in zip(bounds, bounds[1:], strict=False) if p[0] < q[0] and p[1] < q[1])
    return sorted(found)


def _runs(matches: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Line numbers of the runs of matches, consecutive on both sides, with enough words."""
    out: list[int] = []
    run: list[int] = []
    size, then = 0, (-2, -2)
    for i, j in [*matches, (-1, -1)]:
        if (i - 1, j - 1) != then:
            if size >= least:
                out += run
            run, size = [], 0
        run.append(i)
        size += words[i] if i >= 0 else 0
        then = (i, j)
    return out


def shortest_runs(hashes: list[int], words: list[int], lines: set[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the shortest runs of ``lines`` and blank lines that
    hold ``least`` words: one that begins and one that ends at every line, where
    there is any."""
    out: set[tuple[int, int]] = set()
    start = 0
    for stop, x in enumerate([*hashes, None]):
        if x == 0 or x in lines:
            continue
        if start < stop:
            sums = np.concatenate([[0], np.cumsum(words[start:stop], dtype=np.int64)])
            if sums[-1] >= least:
                ends = np.searchsorted(sums, sums[:-1] + least, "left") - 1
                begins = np.searchsorted(sums, sums[1:] - least, "right") - 1
                out.update((start + i, start + j) for i, j in enumerate(ends.tolist()) if j < stop - start)
                out.update((start + i, start + j) for j, i in enumerate(begins.tolist()) if i >= 0)
        start = stop + 1
    return sorted(out)


def run_digests(hashes: list[int], runs: list[tuple[int, int]]) -> list[int]:
    """A digest of each run's lines, in time that does not grow with its length."""
    heads, powers = [0], [1]
    for x in hashes:
        heads.append((heads[-1] * _BASE + x + _BLANK) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return [(heads[j + 1] - heads[i] * powers[j + 1 - i]) % _PRIME for i, j in runs]


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Line numbers of ``a`` in blocks of lines, consecutive on both sides, that
    hold at least ``least`` words together: blocks that patience diff aligns,
    and all others, wherever they stand in ``b`` and whatever is aligned there."""
    out = set(_runs(patience(a, b), words, least))
    both = set(a).intersection(b) - {0}
    here = shortest_runs(a, words, both, least)
    if all(i in out for run in here for i in run):
        return sorted(out)
    # The shortest run that begins or ends at a line depends on its lines alone.
    size = dict(zip(a, words, strict=True))
    there = shortest_runs(b, [size.get(x, 0) for x in b], both, least)
    held = set(run_digests(b, there))
    marks = [0] * (len(a) + 1)
    for (i, j), digest in zip(here, run_digests(a, here), strict=True):
        if digest in held:
            marks[i] += 1
            marks[j + 1] -= 1
    out.update(i for i, depth in enumerate(accumulate(marks)) if depth)
    return sorted(out)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key: their id (null: the least) and a digest of the text."""
    return docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__digest": F.xxhash64("text")}
    )


def _lines(docs: DataFrame) -> DataFrame:
    """Key, line hashes (0 for a blank line) and words per line of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            hashes, words = [], []
            for text in batch.column(2).to_pylist():
                lines = [] if text is None else text.split("\n")
                counts = [len(x.split()) for x in lines]
                words.append(np.array(counts, np.int32))
                own = [digest(x.strip().encode("utf-8", "replace")) if n else 0 for x, n in zip(lines, counts, strict=True)]
                hashes.append(np.array(own, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))],
                names=[*_KEY, "hashes", "words"],
            )

    schema = "__id long, __digest long, hashes array<bigint>, words array<int>"
    return _keyed(docs).select(*_KEY, "text").mapInArrow(run, schema)


def _common_runs(lines: DataFrame, common: DataFrame, least: int) -> DataFrame:
    """Key and digest of the shortest runs of common lines (rows of own, line)
    that hold the words of a block."""
    known = common.groupBy("own").agg(F.collect_set("line").alias("known")).select("own.*", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, found = [], []
            for row, (hashes, words, own) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                if runs := shortest_runs(hashes, words, set(own), least):
                    digests = set(run_digests(hashes, runs))
                    at += [row] * len(digests)
                    found += digests
            kept = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64())], names=[*_KEY, "run"])

    joined = lines.join(known, _KEY).select(*_KEY, "hashes", "words", "known")
    return joined.mapInArrow(run, "__id long, __digest long, run long")


def _marked(held: DataFrame, by: str) -> DataFrame:
    """Every holder of what at least two documents hold, with the number of
    holders and the first of them."""
    spread = held.groupBy(by).agg(F.count("*").alias("holders"), F.min(F.struct(*_KEY)).alias("first"))
    # Settled on either side of the join, so that a hot line's holders meet it
    # in a join that can be split, and nothing gathers them by line again.
    spread = settle(spread.where("holders > 1"))
    return settle(held.join(spread, by).select(by, F.struct(*_KEY).alias("own"), "holders", "first"))


def _pairs(lines: DataFrame, rare: int, least: int) -> DataFrame:
    """Distinct (later, earlier) documents: all that share a rare line, and each
    with the first that holds the same common line or run of them."""
    held = lines.select(*_KEY, F.explode(F.array_distinct("hashes")).alias("line")).where("line <> 0")
    marked = _marked(held, "line")
    few = (
        marked.where(F.col("holders") <= rare)
        .groupBy("line")
        .agg(F.array_sort(F.collect_list("own")).alias("docs"))  # at most ``rare`` of them
        .select("docs", F.posexplode("docs").alias("at", "later"))
        .where("at > 0")
        .select("later", F.explode(F.slice("docs", F.lit(1), F.col("at"))).alias("earlier"))
    )
    common = marked.where(F.col("holders") > rare)
    # Settled, since its holders are counted and then met again.
    runs = _marked(settle(_common_runs(lines, common, least)), "run")
    many = common.select("own", "first").union(runs.select("own", "first")).where("own > first")
    return few.union(many.select(F.col("own").alias("later"), F.col("first").alias("earlier"))).distinct()


def shared_lines(docs: DataFrame, rare: int = RARE, least: int = BLOCK_WORDS) -> DataFrame:
    """Per document that loses lines: its key, the numbers of those lines, their
    words, and the doc_ids of the earlier documents that hold them."""
    lines = settle(_lines(docs).dropDuplicates(_KEY))
    pairs = _pairs(lines, rare, least)
    sides = pairs.select(F.col("later.*"), "earlier").join(lines, _KEY).select(
        F.col("__id").alias("id"), F.col("__digest").alias("digest"), "hashes", "words", "earlier.*"
    )
    earlier = lines.select(*_KEY, F.col("hashes").alias("others"))
    both = sides.join(earlier, _KEY).select("id", "digest", "__id", "hashes", "words", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, blocks = [], []
            columns = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            for at, (a, words, b) in enumerate(zip(*columns, strict=True)):
                if block := common_blocks(a, b, words, least):
                    rows.append(at)
                    blocks.append(block)
            kept = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(blocks, pa.list_(pa.int32()))], names=["id", "digest", "source_id", "block"]
            )

    found = both.mapInArrow(run, "id long, digest long, source_id long, block array<int>")
    # A document has at most as many sources as lines times rare holders.
    merged = found.groupBy("id", "digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("block")))).alias("deleted"),
        F.array_sort(F.collect_set("source_id")).alias("earlier_ids"),
    )
    return merged.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "deleted", "earlier_ids")


def _without(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents joined with what they lose; ``text`` is what remains, and is
    the same text where nothing is deleted.  The columns of ``docs`` first,
    then __deleted and __earlier."""
    columns = docs.columns
    place = columns.index("text")
    taken = found.withColumnsRenamed({"deleted": "__deleted", "earlier_ids": "__earlier"})
    joined = _keyed(docs).join(taken, _KEY, how).select(*columns, "__deleted", "__earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            for at, gone in enumerate(batch.column(len(columns)).to_pylist()):
                if gone:
                    without = set(gone)
                    texts[at] = "\n".join(x for i, x in enumerate(texts[at].split("\n")) if i not in without)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return joined.mapInArrow(run, joined.schema)


def dedup_lines(docs: DataFrame, rare: int = RARE, least: int = BLOCK_WORDS) -> DataFrame:
    """The documents with their repeated blocks deleted; the columns of ``docs``
    and __changed."""
    out = _without(docs, shared_lines(docs, rare, least), "left")
    return out.select(*docs.columns, F.col("__deleted").isNotNull().alias("__changed"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses lines: how many, the earlier documents that
    hold them, and the text that remains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _without(docs, shared_lines(docs), "inner")
    return out.select(
        "doc_id", F.size("__deleted").cast("long").alias("n_deleted"), F.col("__earlier").alias("earlier_ids"), "text"
    )
