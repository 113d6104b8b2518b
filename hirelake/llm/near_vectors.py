"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are at most sqrt(2 - 2t) apart.  After a fixed
rotation the vector is split into blocks; if the squared distance is within its
budget, it is within its proportional share in at least one block.  For each
block the vectors are range-joined within that share: the first coordinate of
the block is cut into cells as wide as the range, a cell meets itself and the
next one, and full cells are split into tiles.  Candidates are verified with
the cosine of the original vectors in double precision: products of unit vectors
decide pairs that are clearly above or below, and every pair near the threshold is
decided by dot(a, b) / sqrt(dot(a, a) * dot(b, b)), summed in the order of the entries.

Rotated coordinates are rounded to integers small enough that block distances
are exact in single precision, and the range is widened by the rounding.  So a
pair that several blocks find is counted by the first of them alone, and links
are counted within tasks instead of being listed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths; equal
vectors are one class with a multiplicity, so copies are never paired up; rows
with a repeated id are vectors of their own; a null id is never a component's
name unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hirelake.llm.common import settle
from hirelake.llm.components import components, forest
from hirelake.llm.registry import query, table

COSINE = 0.9
BLOCK = 16
SCALE = 512
# Vectors of a cell that one task holds on either side, and their bytes as doubles.
TILE = 32768
TILE_BYTES = 32 << 20
# Pairs whose cosine, taken by unit vectors, is this close to the threshold are decided anew.
SLACK = 1e-9
# Rows of the distance matrix that are made at a time.
ROWS = 256
# Share of a distance matrix from which whole matrices are cheaper than pairs.
DENSE = 0.02


@lru_cache(maxsize=8)
def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _blocks(size: int) -> list[slice]:
    """Blocks of about BLOCK coordinates, of sizes as even as can be."""
    count = max(1, round(size / BLOCK))
    edges = [size * i // count for i in range(count + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _ranges(size: int, cosine: float) -> list[int]:
    """Largest squared integer distance in each block."""
    total = max(0.0, 2 - 2 * cosine)
    out = []
    for block in _blocks(size):
        width = block.stop - block.start
        # Each coordinate is off by half a step at most, a difference by one.
        out.append(math.floor((SCALE * math.sqrt(total * width / size) * (1 + 1e-9) + math.sqrt(width)) ** 2))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest entry is below one: exact,
    and squares neither overflow nor vanish together."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    return np.ldexp(rows, -exponent)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, each sum in the order of the entries."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        return total

    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _cells(classes: DataFrame, cosine: float) -> DataFrame:
    """Per class: the rotated, rounded vector and its cell in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned: list = [None] * batch.num_rows
            cells: list = [None] * batch.num_rows
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == size)
                own = _matrix(pa.chunked_array([batch.column(2).take(pa.array(rows))]), size)
                y = np.rint(_unit(own) @ _rotation(size) * SCALE).astype(np.int16)
                # As wide as the range, so that a range spans two cells at most.
                wide = [max(1, math.ceil(math.sqrt(r))) for r in _ranges(size, cosine)]
                cell_of = np.stack([y[:, b.start] // w for b, w in zip(_blocks(size), wide, strict=True)], axis=1)
                for r, row, cell in zip(rows.tolist(), y, cell_of, strict=True):
                    turned[r], cells[r] = row.tobytes(), cell.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths, pa.int32()), pa.array(turned, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=["class", "copies", "vector", "size", "turned", "cells"],
            )

    added = [
        T.StructField("size", T.IntegerType()),
        T.StructField("turned", T.BinaryType()),
        T.StructField("cells", T.ArrayType(T.IntegerType())),
    ]
    schema = T.StructType([*classes.schema.fields, *added])
    return classes.mapInArrow(run, schema)


def _dealt(cells: DataFrame, tile: int) -> DataFrame:
    """A row for each block, tile pair and side that a vector belongs to.

    In a cell's task (i, j) side 0 is tile i of its own vectors, side 1 its
    tile j (j > i), side 2 tile j of the next cell's vectors.
    """
    placed = cells.select("class", "copies", "vector", "size", "turned", F.posexplode("cells").alias("block", "cell"))
    # At most as many cells as the unit interval has ranges, a few for each block.
    counts = placed.groupBy("size", "block", "cell").count()
    beside = counts.select("size", "block", (F.col("cell") - 1).alias("cell"), "count")
    room = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("size")))))
    tiles = (
        counts.union(beside)
        .groupBy("size", "block", "cell")
        .agg(F.max("count").alias("most"))
        .select("size", "block", "cell", F.ceil(F.col("most") / room).cast("int").alias("tiles"))
    )
    here = placed.withColumn("side", F.lit(0)).union(
        placed.withColumn("cell", F.col("cell") - 1).withColumn("side", F.lit(2))
    )
    known = here.join(F.broadcast(tiles), ["size", "block", "cell"])
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = F.when(
        F.col("side") == 0,
        F.concat(
            F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("as"))),
            F.transform(
                F.filter(every, lambda i: i < F.col("own")),
                lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("as")),
            ),
        ),
    ).otherwise(F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(2).alias("as"))))
    return (
        known.withColumn("own", own)
        .withColumn("pair", F.explode(pairs))
        .select("size", "block", "cell", "pair.i", "pair.j", F.col("pair.as").alias("side"), "class", "copies", "vector", "turned")
    )


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length, none null, as rows."""
    values = np.asarray(vectors.combine_chunks().flatten())
    return values.reshape(-1, size).astype(np.float64)


class _Side:
    """The vectors on one side of a task, by their first coordinate in the block."""

    def __init__(self, data: pa.Table, size: int, block: slice):
        turned = np.frombuffer(b"".join(data.column("turned").to_pylist()), np.int16).reshape(-1, size)
        order = np.argsort(turned[:, block.start], kind="stable")
        self.ids = data.column("class").to_numpy()[order]
        self.copies = data.column("copies").to_numpy()[order]
        self.plain = _scaled(_matrix(data.column("vector"), size)[order])
        self.unit = _unit(self.plain)
        self.turned = turned[order].astype(np.float32)
        self.first = self.turned[:, block.start]

    def left(self, block: slice, rows: slice) -> np.ndarray:
        y = self.turned[rows, block]
        return np.concatenate([y, (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1), np.float32)], axis=1)

    def right(self, block: slice, rows: slice = slice(None)) -> np.ndarray:
        y = self.turned[rows, block]
        return np.concatenate([-2 * y, np.ones((len(y), 1), np.float32), (y * y).sum(axis=1, keepdims=True)], axis=1).T


def _linked(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, near: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs are linked, given their cosines up to rounding."""
    linked = near >= cosine
    close = np.flatnonzero(np.abs(near - cosine) <= SLACK)
    if len(close):
        linked[close] = exact_cosine(a.plain[i[close]], b.plain[j[close]]) >= cosine
    return linked


def _meet(a: _Side, b: _Side, size: int, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs linked whose first block within its range is ``block``; of a
    side with itself, each pair once."""
    blocks, ranges = _blocks(size), _ranges(size, cosine)
    right, reach = b.right(blocks[block]), math.sqrt(ranges[block])
    for at in range(0, len(a.ids), ROWS):
        rows = slice(at, min(at + ROWS, len(a.ids)))
        # Only columns whose first coordinate is within the range of some row's.
        begin = at if a is b else int(np.searchsorted(b.first, a.first[at] - reach))
        end = int(np.searchsorted(b.first, a.first[rows.stop - 1] + reach, "right"))
        if begin >= end:
            continue
        near = a.left(blocks[block], rows) @ right[:, begin:end] <= ranges[block]
        if a is b:
            square = rows.stop - at
            near[:, :square] &= ~np.tri(square, min(square, end - begin), dtype=bool)
        count = np.count_nonzero(near)
        if count > DENSE * near.size:
            columns = slice(begin, end)
            for earlier in range(block):
                near &= a.left(blocks[earlier], rows) @ b.right(blocks[earlier], columns) > ranges[earlier]
            found = a.unit[rows] @ b.unit[columns].T
            near &= found >= cosine - SLACK
            i, j = np.divmod(np.flatnonzero(near), end - begin)
            linked = _linked(a, b, i + at, j + begin, found[i, j], cosine)
            yield i[linked] + at, j[linked] + begin
        elif count:
            i, j = np.divmod(np.flatnonzero(near), end - begin)
            i, j = i + at, j + begin
            for earlier in range(block):
                apart = ((a.turned[i, blocks[earlier]] - b.turned[j, blocks[earlier]]) ** 2).sum(axis=1) > ranges[earlier]
                i, j = i[apart], j[apart]
            linked = _linked(a, b, i, j, np.einsum("ij,ij->i", a.unit[i], b.unit[j]), cosine)
            yield i[linked], j[linked]


def _found(cells: DataFrame, cosine: float, tile: int) -> DataFrame:
    """Rows (class, other, links): with a null ``other`` a part of the class's
    count of linked vectors, else an edge of a forest of the task's links."""

    def run(key: tuple, data: pa.Table) -> pa.Table:
        size, block = key[0].as_py(), key[1].as_py()
        lead = _blocks(size)[block]
        parts = [data.filter(pa.compute.equal(data["side"], s)) for s in (0, 1, 2)]
        sides = [_Side(part, size, lead) if len(part) else None for part in parts]
        mine, second, other = sides
        tile_of_itself = key[3].as_py() == key[4].as_py()
        edges_a, edges_b, held = [], [], 0
        counts: dict[int, np.ndarray] = {}
        for x, y in ((mine, mine if tile_of_itself else second), (mine, other)):
            if x is None or y is None:
                continue
            for side in (x, y):
                counts.setdefault(id(side), np.zeros(len(side.ids), np.int64))
            for i, j in _meet(x, y, size, block, cosine):
                counts[id(x)] += np.bincount(i, y.copies[j], len(x.ids)).astype(np.int64)
                counts[id(y)] += np.bincount(j, x.copies[i], len(y.ids)).astype(np.int64)
                edges_a.append(x.ids[i])
                edges_b.append(y.ids[j])
                held += len(i)
                if held > 1 << 20:
                    u, v = forest(np.concatenate(edges_a), np.concatenate(edges_b))
                    edges_a, edges_b, held = [u], [v], 0
        empty = np.empty(0, np.int64)
        u, v = forest(np.concatenate([*edges_a, empty]), np.concatenate([*edges_b, empty]))
        found = [(s.ids[n > 0], n[n > 0]) for s in sides if s is not None and (n := counts.get(id(s))) is not None]
        ids = np.concatenate([*(i for i, _ in found), empty])
        links = np.concatenate([*(n for _, n in found), empty])
        return pa.table(
            {
                "class": np.concatenate([ids, u]),
                "other": pa.array([*[None] * len(ids), *v.tolist()], pa.int64()),
                "links": np.concatenate([links, np.zeros(len(u), np.int64)]),
            }
        )

    dealt = _dealt(cells, tile)
    return dealt.groupBy("size", "block", "cell", "i", "j").applyInArrow(run, "class long, other long, links long")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tile: int = TILE, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must lie in (0, 1]")
    plain = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = plain.withColumn("usable", usable)
    good = marked.where("usable").select("vec_id", "vector")
    classes = settle(
        good.groupBy("vector")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    cells = settle(_cells(classes.select("class", "copies", "vector"), cosine))
    found = settle(_found(cells, cosine, tile))
    counts = found.where("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select("class", "other"))
    rooted = (
        classes.join(counts, "class", "left")
        .join(joined.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("component", "class"))
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(names, "root").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = marked.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS a, b.n AS b, b.vec_id AS other FROM good a, good b
          WHERE a.n <> b.n AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(n, o) AS (SELECT n, n FROM good UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.o),
named AS (SELECT r.n, min(g.vec_id) AS component_id FROM reach r JOIN good g ON g.n = r.o GROUP BY r.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT g.vec_id, coalesce(c.n_links, 0) AS n_links, m.component_id, g.vec_id = m.component_id AS kept
FROM good g JOIN named m ON m.n = g.n LEFT JOIN counted c ON c.n = g.n
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM good)
"""


@query("op4_near_vectors", SQL)
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
