"""Connected components against plain union-find."""

from __future__ import annotations

import random

import pytest

from hirelake.llm.components import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty", "copies"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        "path": [(i, i + 1) for i in rng.sample(range(300), 300)],
        "star": [(7, i) for i in range(500)] + [(-5, 7)],
        "empty": [(4, 4)],
        "copies": [(1, 2)] * 50 + [(2, 1)] * 50 + [(9, 9), (3, 2)],
    }[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in list(root))
