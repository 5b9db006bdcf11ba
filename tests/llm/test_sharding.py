from collections import Counter

import numpy as np
import pytest

from auger.llm import sharding


@pytest.mark.parametrize("good, total, draws", [(3, 10, 4), (0, 5, 2), (5, 5, 3), (40, 200, 50), (7, 8, 7)])
def test_hypergeometric_follows_its_law(good, total, draws):
    rng, ref = np.random.default_rng(1), np.random.default_rng(2)
    mine = np.array([sharding.hypergeometric(rng, good, total, draws) for _ in range(4000)])
    theirs = ref.hypergeometric(good, total - good, draws, 4000)
    for k in range(good + 1):
        assert abs((mine == k).mean() - (theirs == k).mean()) < 0.05
    assert abs(mine.mean() - draws * good / total) < 0.15


def test_hypergeometric_of_large_numbers():
    rng = np.random.default_rng(0)
    n = 10 ** 13
    x = [sharding.hypergeometric(rng, n // 8, n, n // 1000) for _ in range(50)]
    sd = (n / 1000 * 7 / 64) ** 0.5
    assert abs(np.mean(x) - n / 8000) < 5 * sd / 7 and np.std(x) < 2 * sd


def test_matrix_sums():
    rows, sizes = [5, 0, 17, 3, 25], [17, 17, 16]
    m = sharding.communication_matrix(rows, sizes, 3)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m)] == sizes


def test_every_row_once_and_sizes_exact(spark, odd_docs, no_docs):
    out = sharding.shard(odd_docs, 4, seed=1, n_blocks=8, n_ranges=3)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    by = Counter(r["shard"] for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 4
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    assert sharding.shard(no_docs, 4).count() == 0
    few = sharding.shard(odd_docs.limit(2), 4).collect()
    assert sorted(r["shard"] for r in few) == [0, 1]


def test_shuffle_is_uniform(spark):
    n, shards = 60, 3
    place = np.zeros((n, shards))
    first = Counter()
    for seed in range(12):
        for r in sharding.shard(spark.range(n), shards, seed=seed, n_blocks=5, n_ranges=4).collect():
            place[r["id"], r["shard"]] += 1
            first[r["slot"] < 10] += r["id"]
    assert (place.sum(axis=0) == 12 * n / shards).all()
    assert np.abs(place[:30].sum(axis=0) - 120).max() < 40  # early rows spread over all shards
    assert 10 < first[True] / (12 * 3 * 10) < 50


def test_query_slots(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op10_uniform_shards"](spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import zlib
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert len(rows) == len(text) and {r["law"] for r in rows} == {"rows"}
