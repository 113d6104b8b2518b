"""Alignment of two tokenizers by the byte offsets at which both end a token.

Every text is encoded by a byte-level BPE (A, of space and text) and by a piece
model (B, which adds the space itself).  The ends of the tokens of either side
are ascending byte offsets; the shorter list drives an exponential and binary
search into the longer one.  The offsets found in both cut the text into groups,
and differences of ranks tell how many tokens of either side a group holds.  All
tokens of A and B in a group are linked.

How many documents of the corpus link a pair of ids is counted over chunks of
documents: a chunk lists its distinct pairs once, sums are combined before the
shuffle, and each chunk gets the counts of its own pairs back.  So neither the
pairs nor their counts are ever in one place, and a frequent pair costs one row
for each chunk that holds it.

Defined results: a null or empty text, or one that either side's tokens do not
spell byte for byte, has no tokens: zeros, and '' in place of the digest;
repeated rows are documents of their own; null ids are kept; an empty table gives
an empty result; texts are taken whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hirelake.llm.common import settle, slices
from hirelake.llm.registry import query, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text whose documents share one list of pairs (one document, however long).
CHUNK_BYTES = 16 << 20
# Groups with more links than this are counted by distinct ids, not by occurrences.
WIDE = 64
# Tokenizer files are sent to all executors and must stay small.
MAX_FILE = 64 << 20


# ---- tokenizers: ids of texts, and the bytes of each id ----


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file.  Where its merges are ranked like its ids and it
    splits by the usual pattern, tiktoken encodes, which gives the same ids."""

    def __init__(self, data: bytes):
        self.own = tokenizers.Tokenizer.from_str(data.decode())
        self.own.encode_special_tokens = True
        letters = _byte_of_letter()
        vocabulary = {p: bytes(letters[c] for c in p) for p in self.own.get_vocab(with_added_tokens=False)}
        self.bytes = [b""] * (max(self.own.get_vocab().values(), default=-1) + 1)
        ranks = {}
        for piece, spelled in vocabulary.items():
            self.bytes[self.own.token_to_id(piece)] = spelled
            ranks[spelled] = self.own.token_to_id(piece)
        self.quick = None
        if self._usual(json.loads(data), len(ranks)):
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _usual(spec: dict, size: int) -> bool:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        vocabulary = model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [vocabulary[m] for m in merged]
        return (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and order == list(range(256, size))
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + text for text in texts]
        if self.quick is not None:
            return [self.quick.encode_ordinary(text) for text in spaced]
        return [e.ids for e in self.own.encode_batch(spaced, add_special_tokens=False)]


class Pieces:
    """A piece model, which puts the space before a text itself."""

    def __init__(self, data: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [self._spelled(i) for i in range(self.own.get_piece_size())]

    def _spelled(self, ident: int) -> bytes:
        piece = self.own.id_to_piece(ident)
        return bytes([int(piece[3:5], 16)]) if self.own.is_byte(ident) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tools(first: bytes, second: bytes) -> Aligner:
    return Aligner(ByteLevel(first), Pieces(second))


def _loaded(name: str) -> bytes:
    with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
        data = file.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{name} is over {MAX_FILE} bytes")
    return data


# ---- alignment of a batch of texts ----


def gallop(drivers: np.ndarray, targets: np.ndarray, hints: np.ndarray) -> np.ndarray:
    """For each driver the first index whose target is not below it, by exponential
    search from its hint and binary search in what that leaves.  All drivers
    step together; each ends after steps in the logarithm of its hint's error.
    The last target is not below any driver."""
    hints = np.clip(hints, 0, len(targets) - 1)
    low, high = hints.copy(), hints.copy()  # target[low] < driver <= target[high], once settled
    rising = targets[hints] < drivers
    for up in (True, False):
        active = np.flatnonzero(rising == up)
        step = 1
        while len(active):
            if up:
                reach = np.minimum(high[active] + step, len(targets) - 1)
                short = targets[reach] < drivers[active]
                high[active] = reach
                low[active[short]] = reach[short]
            else:
                reach = np.maximum(low[active] - step, -1)
                short = (reach >= 0) & (targets[reach] >= drivers[active])
                low[active] = reach
                high[active[short]] = reach[short]
            active = active[short]
            step *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = targets[middle] < drivers[active]
        low[active[below]] = middle[below]
        high[active[~below]] = middle[~below]
        active = active[high[active] - low[active] > 1]
    return high


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): the owner 0 0 1 1 1 and the rank 0 1 0 1 2 of each item."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligned:
    """Groups of the texts of a batch: token ranks of A and B that end together."""

    def __init__(self, a_ends: list[np.ndarray], b_ends: list[np.ndarray]):
        """Ends per text; those of one text are ascending and have the last in common."""
        self.a_count = np.array([len(e) for e in a_ends], np.int64)
        self.b_count = np.array([len(e) for e in b_ends], np.int64)
        size = np.array([e[-1] if len(e) else 0 for e in a_ends], np.int64)
        base = np.cumsum(size) - size
        texts, a_ranks, b_ranks = [], [], []
        for a_drives in (True, False):
            own = np.flatnonzero((self.a_count <= self.b_count) == a_drives)
            if not self.a_count[own].sum():
                continue
            ends = (a_ends, b_ends) if a_drives else (b_ends, a_ends)
            drivers, targets = (np.concatenate([side[t] + base[t] for t in own.tolist()]) for side in ends)
            n_drivers, n_targets = (
                (self.a_count[own], self.b_count[own]) if a_drives else (self.b_count[own], self.a_count[own])
            )
            text, rank = _runs(n_drivers)
            start = np.cumsum(n_targets) - n_targets
            found = gallop(drivers, targets, start[text] + rank * n_targets[text] // n_drivers[text])
            both = targets[found] == drivers
            text, rank, other = text[both], rank[both], (found - start[text])[both]
            texts.append(own[text])
            a_ranks.append(rank if a_drives else other)
            b_ranks.append(other if a_drives else rank)
        none = np.empty(0, np.int64)
        text = np.concatenate([none, *texts])
        order = np.argsort(text, kind="stable")
        self.text = text[order]
        # Ranks over the whole batch; a group is what lies behind the one before.
        self.a_last = np.concatenate([none, *a_ranks])[order] + (np.cumsum(self.a_count) - self.a_count)[self.text]
        self.b_last = np.concatenate([none, *b_ranks])[order] + (np.cumsum(self.b_count) - self.b_count)[self.text]
        self.a_first, self.b_first = (np.concatenate([[0], last[:-1] + 1])[: len(last)] for last in (self.a_last, self.b_last))
        self.n_a = self.a_last - self.a_first + 1
        self.n_b = self.b_last - self.b_first + 1
        self.groups = np.bincount(self.text, minlength=len(a_ends))
        self.links = np.bincount(self.text, self.n_a * self.n_b, len(a_ends)).astype(np.int64)


class Aligner:
    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.a_length = np.array([len(b) for b in first.bytes], np.int64)
        self.b_length = np.array([len(b) for b in second.bytes], np.int64)
        self.width = len(second.bytes)
        # An id followed by what separates it from the next one.
        most = max(len(first.bytes), self.width)
        self.written = [f"{i}{sign}".encode() for i in range(most) for sign in ",|;"]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of either side; none where a side does not spell the text."""
        none = np.empty(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        full = [i for i, text in enumerate(texts) if text]
        plain = [texts[i] for i in full]
        for i, text, x, y in zip(full, plain, self.first.encode(plain), self.second.encode(plain), strict=True):
            wanted = b" " + text.encode()
            if b"".join(map(self.first.bytes.__getitem__, x)) == wanted == b"".join(map(self.second.bytes.__getitem__, y)):
                a[i], b[i] = np.array(x, np.int64), np.array(y, np.int64)
        return a, b

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> Aligned:
        return Aligned([np.cumsum(self.a_length[x]) for x in a], [np.cumsum(self.b_length[y]) for y in b])

    def digests(self, found: Aligned, a: np.ndarray, b: np.ndarray) -> list[str]:
        """Per text the digest of ``a1,a2|b1;a3|b2,b3``, '' without tokens."""
        items = np.empty(len(a) + len(b), np.int64)
        a_signs, b_signs = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_signs[found.a_last], b_signs[found.b_last] = 1, 2
        # Before a token of A stand the tokens of B of the groups before, and so on.
        items[np.arange(len(a)) + np.repeat(found.b_first, found.n_a)] = a * 3 + a_signs
        items[np.arange(len(b)) + np.repeat(found.a_last + 1, found.n_b)] = b * 3 + b_signs
        out, at = [], 0
        for size in (found.a_count + found.b_count).tolist():
            listed = b"".join(map(self.written.__getitem__, items[at : at + size].tolist()))
            out.append(hashlib.sha256(listed[:-1]).hexdigest() if size else "")
            at += size
        return out

    def links(self, found: Aligned, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, occurrences) of the linked id pairs, ascending and distinct;
        a pair is the id of A times the size of B's vocabulary plus the id of B."""
        sizes = found.n_a * found.n_b
        narrow = np.flatnonzero(sizes <= WIDE)
        group, rank = _runs(sizes[narrow])
        group = narrow[group]
        n_b = found.n_b[group]
        texts = [found.text[group]]
        pairs = [a[found.a_first[group] + rank // n_b] * self.width + b[found.b_first[group] + rank % n_b]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(sizes > WIDE).tolist():
            x, nx = np.unique(a[found.a_first[g] : found.a_last[g] + 1], return_counts=True)
            y, ny = np.unique(b[found.b_first[g] : found.b_last[g] + 1], return_counts=True)
            texts.append(np.full(len(x) * len(y), found.text[g]))
            pairs.append((x[:, None] * self.width + y).ravel())
            times.append((nx[:, None] * ny).ravel())
        text, pair, count = map(np.concatenate, (texts, pairs, times))
        if not len(text):
            return text, pair, count
        # One key of both, so that one sort does.
        space = len(self.first.bytes) * self.width
        key = text * space + pair
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        return key // space, key % space, np.add.reduceat(count[order], first)


# ---- chunks of documents, and the corpus-wide counts ----


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class _Chunk:
    """Documents in the making of one row: figures of each, pairs in common."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.figures: list[np.ndarray] = []
        self.digests: list[str] = []
        self.text: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.rows = self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None], tools: Aligner) -> None:
        a, b = tools.tokens(texts)
        found = tools.align(a, b)
        a, b = np.concatenate(a), np.concatenate(b)
        text, pair, times = tools.links(found, a, b)
        self.ids.append(ids)
        self.figures.append(np.stack([found.a_count, found.b_count, found.groups, found.links]))
        self.digests += tools.digests(found, a, b)
        self.text.append(text + self.rows)
        self.pair.append(pair)
        self.times.append(times)
        self.rows += len(texts)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        text, pair = np.concatenate(self.text), np.concatenate(self.pair)
        pairs, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
        # Places ascend within a document, so their differences are small.
        step = np.diff(place, prepend=0)
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        step[starts] = place[starts]
        columns = [
            pa.array([number], pa.int64()),
            _one(pa.concat_arrays(self.ids)),
            *(_one(pa.array(f)) for f in np.concatenate(self.figures, axis=1)),
            _one(pa.array(self.digests, pa.string())),
            _one(pa.array(np.bincount(text, minlength=self.rows))),
            pa.array([_packed(step)], pa.binary()),
            pa.array([_packed(np.concatenate(self.times))], pa.binary()),
            _one(pa.array(pairs)),
            _one(pa.array(holders.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunks(docs: DataFrame, ident: str, text: str, first: str, second: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((_loaded(first), _loaded(second)))
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(plain.schema["doc_id"].dataType))])
    for name in FIGURES:
        schema = schema.add(name, longs)
    schema = schema.add("digests", T.ArrayType(T.StringType())).add("held", longs).add("places", T.BinaryType())
    schema = schema.add("times", T.BinaryType()).add("pairs", longs).add("holders", longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(*sent.value)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in slices(batches):
            chunk.add(batch.column(0), batch.column(1).to_pylist(), tools)
            chunk.bytes += batch.nbytes
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk.row(number, schema)
                number, chunk = number + 1, _Chunk()
        if chunk.rows:
            yield chunk.row(number, schema)

    return plain.mapInArrow(run, schema)


def align_documents(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``first`` is a byte-level BPE file, ``second`` a piece model; names without a
    slash are those of the public tokenizers.  Each text is encoded once.
    """
    chunks = settle(_chunks(docs, ident, text, first, second))
    width = len(_tools(_loaded(first), _loaded(second)).second.bytes)
    held = chunks.select(F.col("chunk").alias("holder"), F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "one"))
    held = held.select("holder", "place", F.col("one.pairs").alias("pair"), F.col("one.holders").alias("holders"))
    counted = held.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("a", F.expr(f"pair div {width}"))
    highest = counted.groupBy("a").agg(F.max("count").alias("highest"))
    known = counted.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    found = held.select("holder", "place", "pair").join(known, "pair").select("holder", "place", "count", "best")
    schema = T.StructType([T.StructField("doc_id", chunks.schema["ids"].dataType.elementType)])
    for name in (*FIGURES, "n_best", "count_sum"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("groups_sha256", T.StringType())

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        size = len(counts)
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = counts["place"].to_numpy()
        count[at], best[at] = counts["count"].to_numpy(), counts["best"].to_numpy()
        held = rows["held"].combine_chunks().flatten().to_numpy()
        step, times = _unpacked(rows["places"][0].as_py()), _unpacked(rows["times"][0].as_py())
        end = np.cumsum(held)

        def until(values: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(values)])

        # Steps add up within a document.
        steps = until(step)
        place = steps[1:] - np.repeat(steps[end - held], held)
        sums = [until(times * by[place]) for by in (best, count)]
        flat = [rows[c].combine_chunks().flatten() for c in ("ids", *FIGURES)]
        columns = [*flat, *(pa.array(s[end] - s[end - held]) for s in sums), rows["digests"].combine_chunks().flatten()]
        return pa.table(columns, names=schema.names)

    kept = chunks.drop("pairs", "holders")
    return kept.groupBy("chunk").cogroup(found.groupBy("holder")).applyInArrow(run, schema)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by both tokenizers, with its groups and corpus-wide counts of its links."""
    return align_documents(table(spark, sf_dir, "documents"))
