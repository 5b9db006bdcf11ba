import math
from collections import Counter

import numpy as np
import pytest

from auger.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, point string"


def brute(rows, t):
    n = len(rows)
    vec = []
    for _, v, label, *_ in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vec.append(np.array(v, dtype=np.float32).astype(float) if ok else None)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    pairs = set()
    for i in range(n):
        for j in range(i):
            if vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                if vec[i] @ vec[j] / np.sqrt(vec[i] @ vec[i]) / np.sqrt(vec[j] @ vec[j]) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
                    pairs.add((rows[j][0], rows[i][0]))
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    ids = {f: min([x for x in v if x is not None], default=None) for f, v in least.items()}
    return Counter((rows[i][0], links[i], ids[find(i)], rows[i][0] == ids[find(i)]) for i in range(n)), pairs


def vectors(n=400, d=12, seed=0, labels=3, clusters=40, noise=0.25):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d))
    x = centre[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, d))
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, labels)), 1, "p") for i in range(n)]


@pytest.mark.parametrize("block, noise, d", [(2048, 0.25, 12), (16, 0.25, 12), (32, 1.0, 40), (16, 0.01, 4)])
def test_against_brute_force(spark, monkeypatch, block, noise, d):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(d=d, noise=noise)
    rows += [(1000 + i, rows[0][1], rows[0][2], 1, "p") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, pairs = brute(rows, 0.93)
    got = E.near_duplicates(df, 0.93).collect()
    assert Counter(tuple(r) for r in got) == want
    first = lambda i: 0 if i >= 1000 else i  # noqa: E731  one of the equal vectors stands for all
    listed = {tuple(sorted((first(r["a"]), first(r["b"])))) for r in E.threshold_pairs(df, 0.93).collect()}
    assert listed == {p for p in pairs if p[1] < 1000}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, 1, ""), (2, [2.0, 4.0, 6.0], 0, 1, ""), (3, v, 1, 1, ""), (4, v, None, 1, ""), (5, None, 0, 1, ""), (6, [], 0, 1, ""),
            (7, [0.0, 0.0, 0.0], 0, 1, ""), (8, [1.0, None, 3.0], 0, 1, ""), (9, [1.0, float("nan"), 3.0], 0, 1, ""),
            (10, [1.0, float("inf"), 3.0], 0, 1, ""), (11, [1.0, 2.0], 0, 1, ""), (1, v, 0, 1, ""), (None, v, 0, 1, ""), (12, [1e-30, 2e-30, 3e-30], 0, 1, ""),
            (13, [1e30, 2e30, 3e30], 0, 1, "")]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for i in (1, 2, 12, 13, None):
        assert all((r["n_links"], r["component_id"], r["kept"]) == (5, 1, i == 1) for r in by[i])
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert [(r["n_links"], r["component_id"], r["kept"]) for r in by[i]] == [(0, i, True)]


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA), 0.93).count() == 0


def test_tree_levels_nest_and_cover():
    x = E._unit(np.random.default_rng(1).normal(size=(300, 5)))
    tree = E.CoverTree(x, 0.05)
    for i, level in enumerate(tree.levels):
        for b, e, c, r in zip(level["begin"], level["end"], level["centre"], level["radius"]):
            rows = tree.order[b:e]
            assert c in rows and E._distance(x[c][None], x[rows]).max() <= r + E.SLACK
        if i:
            assert set(tree.levels[i - 1]["centre"]) <= set(level["centre"])
            assert level["radius"].max() <= tree.levels[0]["radius"][0] / 2 ** i + 0.05


def test_pruning_drops_most_pairs():
    rng = np.random.default_rng(3)
    x = E._unit(np.repeat(rng.normal(size=(20, 32)), 20, axis=0) + 0.05 * rng.normal(size=(400, 32)))
    seen = 0
    plain = E._distance

    def counted(a, b):
        nonlocal seen
        seen += len(a) * len(b)
        return plain(a, b)
    tree = E.CoverTree(x, 0.1)
    E._distance = counted
    try:
        a, b = E.dual_traversal(tree, tree, 0.93)
    finally:
        E._distance = plain
    assert seen < 400 * 400 / 3
    assert set(zip(a, b)) == set(zip(*np.nonzero(x @ x.T >= 0.93)))
