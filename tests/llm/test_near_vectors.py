"""Near-duplicate vectors against brute force in double precision."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hirelake.llm import near_vectors as nv
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


def plain(rows, cosine=nv.COSINE):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector)."""
    ok = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    links = [[] for _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((name, len(links[i]), least, name == least))
    return sorted(out, key=str)


def clusters(rng, size, count, each, noise):
    base = rng.standard_normal((count, size))
    return [(b + rng.standard_normal(size) * noise * np.linalg.norm(b) / math.sqrt(size)).astype(np.float32).tolist() for b in base for _ in range(each)]


@pytest.mark.parametrize(("size", "tile"), [(64, nv.TILE), (64, 20), (7, 9), (50, 30)])
def test_against_brute_force(spark, size, tile):
    rng = np.random.default_rng(size + tile)
    vectors = clusters(rng, size, 12, 9, 0.33) + clusters(rng, size, 2, 30, 0.1) + clusters(rng, size, 60, 1, 0)
    vectors += [vectors[0], vectors[0], [3 * x for x in vectors[1]], [-x for x in vectors[2]]]
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[k]) for i, k in enumerate(order)]
    rows += [
        (900, None), (901, []), (902, [0.0] * size), (903, [math.nan] * size), (904, [math.inf] + [1.0] * (size - 1)),
        (905, [None] + [1.0] * (size - 1)), (906, [1.0] * (size + 1)), (907, [2.0] * (size + 1)), (None, vectors[5]), (3, rows[3][1]),
    ]
    frame = spark.createDataFrame([(v, i, 1) for i, v in rows], "embedding array<float>, vec_id long, class int")
    got = sorted((tuple(r) for r in nv.near_duplicates(frame, tile=tile).collect()), key=str)
    assert got == plain(rows)
    assert sum(r[1] > 0 for r in got) > 60


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nv.near_duplicates(frame).count() == 0


def test_query_matches_sql(spark):
    got = nv.op4_near_vectors(spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).execute(nv.SQL).df()) is None


def at_threshold():
    """Integer vectors of which many pairs have a cosine of exactly 0.9."""
    squares = [(x, y, z) for x in range(-4, 5) for y in range(-4, 5) for z in range(-4, 5) if x * x + y * y + z * z == 19]
    ends = [[9 * k, *(k * c for c in s)] for s in squares for k in (1, 3, 7)]
    return [[float(k), 0.0, 0.0, 0.0] for k in (1, 2, 5, 11)] + [list(map(float, v)) for v in ends]


def exact(a, b):
    """Is dot(a, b) / (|a| |b|) >= 0.9, in whole numbers?"""
    a, b = [int(x) for x in a], [int(x) for x in b]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return dot > 0 and 100 * dot * dot >= 81 * sum(x * x for x in a) * sum(y * y for y in b)


@pytest.mark.parametrize("dense", [-1.0, 2.0])
def test_pairs_at_the_threshold_link_in_both_branches(monkeypatch, dense):
    monkeypatch.setattr(nv, "DENSE", dense)
    rows = np.array(at_threshold())
    turned = np.rint(nv._unit(rows) @ nv._rotation(4) * nv.SCALE).astype(np.int16)
    table = nv.pa.table({"class": np.arange(len(rows)), "copies": np.ones(len(rows), np.int64), "vector": rows.tolist(), "turned": [t.tobytes() for t in turned]})
    side = nv._Side(table, 4, nv._blocks(4)[0])
    got = {frozenset((int(side.ids[a]), int(side.ids[b]))) for i, j in nv._meet(side, side, 4, 0, 0.9) for a, b in zip(i, j, strict=True)}
    want = {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if exact(rows[i], rows[j])}
    assert got == want and sum(min(pair) < 4 <= max(pair) for pair in got) == 4 * (len(rows) - 4)


def test_pairs_at_the_threshold_equal_sql(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(at_threshold())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings")
    db = connect(FOLDER)
    db.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    assert compare(nv.near_duplicates(frame).toPandas(), db.execute(nv.SQL).df()) is None


def test_entries_of_any_size_are_scaled_exactly():
    a, b = np.array([[1.0, 0, 0, 0]]), np.array([[9.0, 3, 3, 1]])
    for power in (-1000, -500, 0, 500, 1000):
        assert nv.exact_cosine(nv._scaled(np.ldexp(a, power)), nv._scaled(np.ldexp(b, -power // 2)))[0] == 0.9
