"""Components against plain search: chains in order, stars, rings, and random graphs."""

from __future__ import annotations

import random

import pytest

from attestor.llm.components import components

rng = random.Random(7)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(500 + i, 700) for i in range(100)], "ring": [(i, (i + 1) % 97) for i in range(97)],
    "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (3, 4)], "none": [], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "negative": [(-5, 3), (3, -9), (7, 8)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    pairs = [(a, b) for a, b in GRAPHS[name] if a != b]
    root = {v: v for p in pairs for v in p}

    def of(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    got = [tuple(r) for r in components(spark.createDataFrame(GRAPHS[name], "a long, b long"), "a", "b").collect()]
    assert sorted(got) == sorted((v, of(v)) for v in root)
