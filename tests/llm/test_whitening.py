import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from auger.llm import whitening

INF, NAN = float("inf"), float("nan")


def plain(vectors, k=8):
    """Brute force on equally long vectors: per vector (deviation, whitened), and (explained, n, covariance)."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * e - s) ** 2 for e, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * e - s) / n for e, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return dev, centred @ axes, values, np.trace(cov)


def check(rows, source, key="vec_id"):
    by_dim = defaultdict(list)
    for i, v in source:
        if v and all(e is not None and math.isfinite(e) for e in v):
            by_dim[len(v)].append((i, v))
    got = defaultdict(list)
    for r in rows:
        got[r[key], r["component"]].append(r)
    assert len(rows) == sum(len(v) * min(d, 8) for d, v in by_dim.items())
    for d, vectors in by_dim.items():
        dev, projected, values, trace = plain([v for _, v in vectors])
        live = values > 1e-9 * max(trace, 1e-300)
        for c in range(min(d, 8)):
            mine = [next(r for r in got[i, c + 1] if int(r["deviation"]) == q) for (i, _), q in zip(vectors, dev)]
            assert all(r["n"] == len(vectors) and r["identity_error"] <= 1e-6 for r in mine)
            if not live[c]:
                assert all(r["whitened"] is None for r in mine)
                continue
            assert all(abs(r["explained"] - values[c] / trace) <= 1e-9 for r in mine)
            z = np.array([r["whitened"] for r in mine])
            want = projected[:, c] / np.sqrt(values[c])
            gap = np.abs(values - values[c])[np.arange(len(values)) != c]
            if not len(gap) or gap.min() > 1e-6 * values[c]:  # the axis is unique
                assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-6
            assert abs((z ** 2).mean() - 1) < 1e-8


def some(n, d, seed):
    g = np.random.default_rng(seed)
    return (g.normal(size=(n, d)) * (1 + np.arange(d))).astype(np.float32).tolist()


def test_equals_brute_force(spark):
    vectors = some(300, 12, 1)
    vectors += [vectors[0]] * 150 + vectors[5:9] * 3
    data = list(enumerate(vectors))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whiten(df, "embedding").collect(), data)


def test_odd_rows(spark):
    data = [(1, None), (2, []), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 0.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
            (8, [3.0, -1.0]), (9, [0.5, 0.25]), (10, [4.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.0]), (13, [1e30, -1e30, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in data],
                               "vec_id long, embedding array<double>, label string, n_copies int, score double").repartition(3)
    rows = whitening.whiten(df, "embedding").collect()
    check([r for r in rows if r["vec_id"] < 11], [x for x in data if x[0] < 11])
    assert Counter(r["component"] for r in rows if r["vec_id"] == 13) == {1: 1, 2: 1, 3: 1}
    assert all(r["label"] == "x" and r["whitened"] is None for r in rows if r["vec_id"] == 10)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(df, "embedding").count() == 0
    assert whitening.whiten(df.where("vec_id > 1"), "embedding").count() == 0


def test_weights_of_one_fit_each_vector_once(spark):
    vectors = some(40, 4, 2)
    df = spark.createDataFrame(list(enumerate(vectors + [vectors[0]] * 60)), "vec_id long, embedding array<float>")
    rows = [r for r in whitening.whiten(df, "embedding", weights="one").collect() if r["vec_id"] < 40]
    check([r.asDict() for r in rows], list(enumerate(vectors)))


def test_large_sums_stay_exact(spark):
    data = [(i, [2.0 ** 30 + i, -(2.0 ** 29), float(i * i)]) for i in range(50)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = dict(zip(range(50), plain([v for _, v in data])[0]))
    for r in whitening.whiten(df, "embedding").collect():
        assert int(r["deviation"]) == want[r["vec_id"]]


def test_query(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, sf).collect(), data)
