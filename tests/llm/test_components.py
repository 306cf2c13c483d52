"""Components against a plain union-find."""

import random

from tracejobs.llm.components import connected_components


def test_components(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges += edges[:3] + [(7, 7), (None, 1), (1, None)]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, top(x)) for x in root)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
