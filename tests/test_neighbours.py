"""Exact kNN join and LOF against brute force, on fixtures with clusters, copies and a hot cell."""

import numpy as np
import pytest

from auger.operators.neighbours import knn_join, local_outlier_factor


def brute(ids, X, k):
    out = {}
    for a in range(len(ids)):
        d = np.sqrt(((X - X[a]) ** 2).sum(axis=1))
        cand = sorted((d[b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[ids[a]] = cand
    return out


@pytest.mark.parametrize("layout", ["clusters", "hot", "copies", "grid", "hot_copies", "dense"])
def test_knn_exact(spark, layout):
    rng = np.random.default_rng(3)
    if layout == "clusters":
        X = np.concatenate([rng.normal(c, 0.3, size=(150, 4)) for c in (0, 3, 9)])
    elif layout == "hot":  # a third of all points packed in one tiny region
        X = np.concatenate([rng.normal(0, 5, size=(300, 4)), rng.normal(50, 1e-3, size=(150, 4))])
    elif layout == "copies":
        base = rng.normal(0, 1, size=(60, 4))
        X = np.concatenate([base, base[:30], base[:10]])
    elif layout == "grid":  # many exactly tied distances between distinct points
        X = np.array([[float(a), float(b), 0.0, 0.0] for a in range(15) for b in range(12)])
    elif layout == "dense":  # distinct points, a third of them in a tiny dense ball
        X = np.concatenate([rng.normal(0, 5, size=(400, 4)), rng.normal(20, 1e-2, size=(200, 4))])
    else:  # one vector copied for a third of all rows, plus a grid with ties
        grid = np.array([[float(a), float(b), 0.0, 0.0] for a in range(10) for b in range(10)])
        X = np.concatenate([grid, np.repeat(grid[37:38], 60, axis=0), grid[:5]])
        X = X[rng.permutation(len(X))]
    ids = np.arange(len(X)) * 7 + 1
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, X)], "id long, v array<double>")
    k = 5
    got = knn_join(df, "id", "v", k, block=40).collect()
    want = brute(ids, X, k)
    by = {}
    for r in got:
        by.setdefault(r["i"], []).append((r["rank"], r["d"], r["j"]))
    assert len(by) == len(ids)
    for i, lst in by.items():
        lst.sort()
        assert [j for _, _, j in lst] == [j for _, j in want[i]]
        assert np.allclose([d for _, d, _ in lst], [d for d, _ in want[i]], atol=1e-9)


def test_lof_copies_are_one(spark):
    X = np.array([[0.0, 0.0]] * 6 + [[5.0, 5.0]])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(X)], "id long, v array<double>")
    lof = {r["i"]: r["lof"] for r in local_outlier_factor(knn_join(df, "id", "v", 3, block=4)).collect()}
    assert lof[0] == 1.0


def test_knn_and_lof_with_salted_hot_keys(spark, monkeypatch):
    import auger.operators.joins as J
    monkeypatch.setattr(J, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(J, "MAX_HOT_KEYS", 3)
    rng = np.random.default_rng(9)
    grid = np.array([[float(a), float(b)] for a in range(6) for b in range(6)])
    X = np.concatenate([grid, np.repeat(grid[7:8], 40, axis=0)])
    ids = np.arange(len(X)) * 3 + 2
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, X)], "id long, v array<double>")
    k = 4
    got = {}
    for r in knn_join(df, "id", "v", k, block=16).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    want = brute(ids, X, k)
    assert all([j for _, j in sorted(got[i])] == [j for _, j in want[i]] for i in ids)
    lof = local_outlier_factor(knn_join(df, "id", "v", k, block=16))
    assert lof.count() == len(ids)


def test_block_measures_few_pairs_directly(monkeypatch):
    import auger.operators.neighbours as N
    rng = np.random.default_rng(4)
    X = rng.normal(30, 1, size=(900, 16))
    X[:50] = rng.normal(-500, 1e-3, size=(50, 16))  # far off and dense
    X[800:] = np.round(X[800:])
    X[850:] = X[800:850] + np.eye(16)[0]  # tied distances
    ids, k = rng.permutation(900) * 3, 7
    D = N._dist_chunked(X, X)
    want = N._topk(ids, D, ids, k)
    pairs, rowdist = [], N._rowdist
    monkeypatch.setattr(N, "_dist_chunked", lambda *a: pytest.fail("all pairs by direct differences"))
    monkeypatch.setattr(N, "_rowdist", lambda A, ia, B, ib: pairs.append(len(ia)) or rowdist(A, ia, B, ib))
    monkeypatch.setattr(N, "CELLS", 10_000)
    key = lambda t: sorted(zip(t["i"], t["j"], np.round(t["d"], 9)))
    assert key(N._knn_block(ids, X, ids, X, k)) == key(want)
    theta = np.sort(D, axis=1)[:, 3]  # with the query itself: the third neighbour's distance
    near = want[want["d"] <= want["i"].map(dict(zip(ids, theta)))]
    assert key(N._knn_block(ids, X, ids, X, k, theta)) == key(near)
    assert sum(pairs) < 20 * len(X)
