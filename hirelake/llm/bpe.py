"""Byte-level BPE encoding and decoding.

Encoding looks a pre-token up in two tiers.  A minimal perfect hash over the
vocabulary resolves pre-tokens that are tokens themselves; every other one is
merged by a heap of neighbouring pairs over a linked list of its bytes.

Defined results: a null text is the empty text; the empty text has no ids and
the digests of no bytes; repeated rows are encoded each on their own; an empty
table gives an empty result; further columns of the input are ignored or, with
``keep``, passed through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T

from hirelake.llm.common import slices
from hirelake.llm.registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Pre-tokens whose ids, and pairs whose rank, a worker remembers; beyond, it
# forgets all and goes on.  Together they take about 150 MB.
REMEMBERED = 1 << 19
REMEMBERED_PAIRS = 1 << 17
# A vocabulary is sent to all executors and must stay a small table.
MAX_VOCABULARY = 1 << 20

_WORD = (1 << 64) - 1
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _slot(h: int, seed: int, size: int) -> int:
    return ((((h ^ (seed * _ODD & _WORD)) * _MIX & _WORD) >> 32) * size) >> 32


@dataclass
class PerfectHash:
    """Minimal perfect hash from token bytes to ranks.

    Keys fall into buckets; buckets of two or more keys hold a seed that sends
    their keys to distinct free slots, those of one key name the slot (as
    -1 - slot).  There are as many slots as keys, and a slot stores its key, so
    that a lookup of any other bytes is told apart.
    """

    seeds: list[int]
    keys: list[bytes]
    ranks: list[int]

    @staticmethod
    def build(vocabulary: dict[bytes, int]) -> PerfectHash:
        size = len(vocabulary)
        buckets = max(1, size // 3)
        members: list[list[bytes]] = [[] for _ in range(buckets)]
        for key in vocabulary:
            members[xxhash.xxh64_intdigest(key) % buckets].append(key)
        seeds, keys, ranks = [0] * buckets, [b""] * size, [0] * size
        taken = bytearray(size)
        for bucket in sorted(range(buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if len(own) <= 1:
                break
            hashes = [xxhash.xxh64_intdigest(key) for key in own]
            seed = 1
            while True:
                slots = [_slot(h, seed, size) for h in hashes]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                seed += 1
            seeds[bucket] = seed
            for key, slot in zip(own, slots, strict=True):
                taken[slot], keys[slot], ranks[slot] = 1, key, vocabulary[key]
        free = (slot for slot in range(size) if not taken[slot])
        for bucket, own in enumerate(members):
            if len(own) == 1:
                slot = next(free)
                seeds[bucket], keys[slot], ranks[slot] = -1 - slot, own[0], vocabulary[own[0]]
        return PerfectHash(seeds, keys, ranks)

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % len(self.seeds)]
        slot = -1 - seed if seed < 0 else _slot(h, seed, len(self.keys))
        return self.ranks[slot] if self.keys[slot] == key else None


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token bytes from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} are sent to the executors")
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes {missing[:5]} are no tokens")
    return ranks


class _Joined(dict):
    """Rank of two neighbouring parts joined, by their ranks; asked once each
    from the perfect hash and -1 where the joined bytes are no token."""

    def __init__(self, hashed: PerfectHash, token: dict[int, bytes]):
        self.hashed, self.token = hashed, token

    def __missing__(self, pair: tuple[int, int]) -> int:
        rank = self.hashed.get(self.token[pair[0]] + self.token[pair[1]])
        if len(self) >= REMEMBERED_PAIRS:
            self.clear()
        self[pair] = rank = -1 if rank is None else rank
        return rank


def merge(parts: list[int], joined: _Joined) -> list[int]:
    """Ids of a pre-token from the ranks of its bytes: the pair of least rank
    merges first, then the leftmost.  Parts are a linked list over byte
    positions; a heap entry names the two parts it saw, and is void once
    either has changed.  ``parts`` is used up."""
    size = len(parts)
    after = list(range(1, size + 1))
    before = list(range(-1, size))
    heap = []
    for i in range(size - 1):
        pair = (parts[i], parts[i + 1])
        rank = joined[pair]
        if rank >= 0:
            heap.append((rank, i, pair))
    heapify(heap)
    while heap:
        rank, i, (left, right) = heappop(heap)
        j = after[i]
        if parts[i] != left or j >= size or parts[j] != right:
            continue
        parts[i], parts[j] = rank, -1
        after[i] = k = after[j]
        if k < size:
            before[k] = i
            pair = (rank, parts[k])
            found = joined[pair]
            if found >= 0:
                heappush(heap, (found, i, pair))
        k = before[i]
        if k >= 0:
            pair = (parts[k], rank)
            found = joined[pair]
            if found >= 0:
                heappush(heap, (found, k, pair))
    return [rank for rank in parts if rank >= 0]


class _Remembered(dict):
    """Ids of a pre-token as little-endian bytes, resolved at first sight."""

    def __init__(self, hashed: PerfectHash, token: dict[int, bytes]):
        self.hashed = hashed
        self.joined = _Joined(hashed, token)
        self.byte = [hashed.get(bytes([b])) for b in range(256)]

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        rank = self.hashed.get(data)
        parts = merge([self.byte[b] for b in data], self.joined) if rank is None else [rank]
        ids = pack(f"<{len(parts)}I", *parts)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Coder:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, hashed: PerfectHash, pattern: str):
        self.hashed, self.pattern = hashed, pattern
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.token = dict(zip(self.hashed.ranks, self.hashed.keys, strict=True))
        self.known = _Remembered(self.hashed, self.token)

    def __getstate__(self):
        return self.hashed, self.pattern

    def __setstate__(self, state):
        self.hashed, self.pattern = state
        self._ready()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Coder:
    """A coder for a rank file; by default the multilingual public vocabulary."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return Coder(PerfectHash.build(load_vocabulary(path)), pattern)


def encode_documents(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    vocabulary: str | None = None,
    ids: bool = True,
) -> DataFrame:
    """Columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked
    for, ids (array of int).  ``decoded_sha256`` is of the bytes decoded from
    the ids.  One pass without a shuffle; the vocabulary is broadcast, its size
    checked when it is loaded."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(coder(vocabulary))
    fields = [docs.schema[c] for c in keep] + [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for batch in slices(batches):
            encoded = [code.encode(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))] + [
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array([hashlib.sha256(code.decode(e)).hexdigest() for e in encoded], pa.string()),
            ]
            if ids:
                columns.append(pa.array([np.frombuffer(e, "<i4") for e in encoded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, T.StructType(fields))


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual vocabulary and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), ids=False)
