"""Whitening against dense eigenvectors and exact integers."""

from __future__ import annotations

from collections import defaultdict
from math import floor

import numpy as np
import pytest

from hirelake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Integer vectors of the fit list, their covariance's eigenpairs."""
    x = np.array([[floor(1024 * float(c)) + 100_000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum(int(d) ** 2 for d in row) for row in x * n - sums]
    return n, deviation, centred, values[::-1], vectors[:, ::-1]


def compare(out, rows, components=8, tight=1e-9):
    """``rows``: (vec_id, vector) of the fit list, ids distinct."""
    n, deviation, centred, values, vectors = plain([v for _, v in rows])
    found = defaultdict(dict)
    for r in out:
        found[r.component][r.vec_id] = r
    assert sorted(found) == list(range(1, components + 1))
    for k, by_id in found.items():
        assert set(by_id) == {i for i, _ in rows}
        want = centred @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        got = np.array([by_id[i].whitened for i, _ in rows])
        got *= np.sign(got @ want)
        assert np.abs(got - want).max() < tight
        for (i, _), d in zip(rows, deviation, strict=True):
            r = by_id[i]
            assert (r.n, int(r.deviation_exact)) == (n, d)
            assert r.deviation == (d if d < 1 << 63 else None)
            assert abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-12
            assert r.identity_error < 1e-9


def test_whitens_the_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = whitening.op11_whitening(spark, folder)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out.collect(), rows)


def test_leaves_out_what_is_not_finite(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(12) * np.linspace(1, 4, 12)).astype(np.float32).tolist()) for i in range(200)]
    bad = [(300, None), (301, []), (302, [None] * 12), (303, [1.0] * 11 + [None]), (304, [float("nan")] * 12)]
    bad += [(305, [float("inf")] + [0.0] * 11), (306, [1.0] * 11 + [float("-inf")])]
    rows = [(i, v, 0) for i, v in bad[:3] + good + bad[3:]]
    data = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compare(whitening.whiten(data).collect(), good)


def test_small_and_degenerate_tables(spark):
    def out(rows, **kw):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA), **kw).collect()

    assert out([]) == []
    assert out([(1, None, 0), (2, [], 0)]) == []
    # One vector, or copies of one, have no variance.
    assert out([(1, [0.5, 1.0], 0)]) == []
    assert out([(i, [0.5, 1.0], 0) for i in range(9)]) == []
    # Two points have one direction; repeated and null ids are rows of their own.
    got = out([(1, [0.0, 0.0], 0), (1, [1.0, 1.0], 0), (None, [1.0, 1.0], 0), (2, [0.0, 0.0], 0)])
    assert [r.component for r in got] == [1, 1, 1, 1]
    assert sorted((str(r.vec_id), round(abs(r.whitened), 12), r.n) for r in got) == [("1", 1.0, 4), ("1", 1.0, 4), ("2", 1.0, 4), ("None", 1.0, 4)]
    # Equal variances: any orthonormal pair will do, so the result is white all the same.
    got = out([(i, [float(a), float(b)], 0) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)] * 3)])
    assert len(got) == 24 and max(r.identity_error for r in got) < 1e-12
    with pytest.raises(Exception, match="cannot be whitened together"):
        out([(1, [1.0], 0), (2, [1.0, 2.0], 0)])
    with pytest.raises(Exception, match="is not below"):
        out([(1, [1e30], 0), (2, [1.0], 0)])


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) * [1e9, 3e8, 1e7] + 5e8).tolist()) for i in range(60)]
    data = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    compare(whitening.whiten(data).collect(), rows, 3, 1e-6)


def test_other_names_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), rng.standard_normal(5).tolist()) for i in range(50)]
    data = spark.createDataFrame(
        [(i, v, [1.0], 1, "x") for i, v in rows], "`a.b` string, v array<double>, vector array<double>, n int, component string"
    )
    out = whitening.whiten(data, 3, "`a.b`", "v")
    compare(out.collect(), rows, 3)


def test_sums_over_many_partitions_are_added_on_executors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 40)
    chunks = whitening._chunks(
        spark.range(0, 1000, 1, 37).selectExpr("id AS vec_id", "array(double(id), double(-id)) AS embedding"), "vec_id", "embedding"
    )
    whole = whitening._total(chunks, 37, whitening._exact_moments).tolist()
    monkeypatch.setattr(whitening, "FAN", 4)
    assert whitening._total(chunks, 37, whitening._exact_moments).tolist() == whole
    x = [1024 * i + 100_000 for i in range(1000)]
    y = [-1024 * i + 100_000 for i in range(1000)]
    assert whole == [[1000, sum(x), sum(y)], [0, sum(a * a for a in x), sum(a * a for a in y)]]


def test_solver_against_dense_matrices():
    rng = np.random.default_rng(4)
    for rows, size, wanted in [(500, 120, 8), (40, 90, 5), (300, 4, 8), (30, 1, 3)]:
        data = rng.standard_normal((rows, size)) * np.linspace(1, 2, size)
        whole = data.T @ data / rows
        found = whitening.jacobi_davidson(lambda block, m=whole: m @ block, size, wanted)
        values = np.linalg.eigvalsh(whole)[::-1][:wanted]
        assert np.allclose(found.values, values, rtol=1e-13)
        residual = whole @ found.vectors - found.vectors * found.values
        assert np.abs(residual).max() < 1e-12 * values[0]
        assert np.abs(found.vectors.T @ found.vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    half = rng.standard_normal((30, 30))
    matrix = half + half.T
    right = rng.standard_normal((30, 3))
    got = whitening.minres(lambda block: matrix @ block, right, 200, 1e-12)
    assert np.allclose(matrix @ got, right, atol=1e-8)
