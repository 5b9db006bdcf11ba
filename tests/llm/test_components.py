import random

import pytest

from auger.llm.components import components


def expected(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {v: find(v) for v in up}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(59 - i, 60 - i) for i in range(40)] + [(0, 100)],
    [(0, i) for i in range(1, 200)], [(1000, i) for i in range(200)],
    [tuple(random.Random(5).sample(range(300), 2)) for _ in range(1)] + [(random.Random(i).randrange(300), random.Random(i + 999).randrange(300)) for i in range(260)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == expected(edges)
