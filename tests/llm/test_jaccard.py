import random
import re
from collections import Counter

import numpy as np
import pytest

from auger.llm import jaccard


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, t=0.8):
    """(doc_id, text) -> per row: class id, links"""
    sets = [shingle_set(x) for _, x in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        d = rows[i][0]
        f = find(i)
        if f not in least or least[f] is None or (d is not None and d < least[f]):
            least[f] = d
    return Counter((rows[i][0], least[find(i)], links[i]) for i in range(n))


def near_copies(seed=3, groups=12, size=9, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(words)] = rng.choice(vocab)
            rows.append((d, " ".join(w)))
            d += 1
    return rows


def found(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect())


@pytest.mark.parametrize("leaf", [64, 4])
def test_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", 512 if leaf == 64 else 4)  # groups of many blocks too
    rows = near_copies()
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert found(got) == brute(rows)
    kept = Counter(r["class_id"] for r in got.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len({c for _, c, _ in brute(rows)})


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(jaccard.jaccard_join(docs)) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = jaccard.jaccard_join(odd_docs)
    assert found(got) == brute(rows)
    assert jaccard.jaccard_join(no_docs).count() == 0


def test_paths_take_a_token_with_probability_one_by_threshold():
    first, second = jaccard._sampled(np.arange(40_000, dtype=np.uint64))
    assert abs((second >= 0).mean() - 0.25) < 0.02 and (first != second).all()
    assert np.bincount(first, minlength=jaccard.SKETCH).min() > 400


def test_recall_of_the_runs(spark):
    """Pairs of similarity near 0.8 that the buckets bring together, before any exact step."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, (300, 450), dtype=np.int64).astype(np.uint64)
    other = np.concatenate([base[:, :400], rng.integers(0, 2 ** 63, (300, 50), dtype=np.int64).astype(np.uint64)], axis=1)
    values = np.sort(np.concatenate([base, other]), axis=1)
    sketch = jaccard._sketches(values.ravel(), np.arange(0, 601) * 450)
    rows = [(i, s.tobytes()) for i, s in enumerate(sketch)]
    edges = {(r["a"], r["b"]) for r in jaccard.candidates(spark.createDataFrame(rows, "row long, sketch binary")).collect()}
    assert sum((i, i + 300) in edges for i in range(300)) >= 297


def test_sketching_holds_little_text_at_once(monkeypatch):
    import pyarrow as pa
    from auger.llm import jaccard as J

    seen, sets = [], J.shingle_sets
    monkeypatch.setattr(J, "shingle_sets", lambda texts, k: seen.append(sum(len(t) for t in texts)) or sets(texts, k))
    texts = [f"{i} some words that go on {i} " * 2000 for i in range(40)]
    n = pa.array(range(40), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, pa.array(texts), n], names=["row", "doc_id", "text", "text_key"])
    assert [r for b in J._sketch_rows(5)([batch]) for r in b.column("row").to_pylist()] == list(range(40))
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 500_000
