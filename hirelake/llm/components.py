"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hirelake.llm.common import settle

# Edges that a task reduces to a forest at a time.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) that connect what the edges connect."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(root, step := root[root]):
            root = step
    members = root != np.arange(len(nodes))
    return nodes[members], nodes[root[members]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def out():
        a = np.concatenate([h[0] for h in held])
        b = np.concatenate([h[1] for h in held])
        a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns), the
    component being the least node reachable.

    Tasks first reduce their own edges to forests.  Then large-star and
    small-star steps alternate until nothing changes; a step sends neighbours
    larger (or all) of a node to the least one, found by a partial aggregate,
    so a node with very many edges costs no more than they do.  Edges are
    checkpointed after each round.
    """
    a, b = edges.columns
    found = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = settle(found.mapInArrow(_thin, "u long, v long").distinct())
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = settle(
            joined.select("u", F.col("m").alias("v"))
            .union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
