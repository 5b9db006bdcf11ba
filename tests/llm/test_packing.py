import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auger.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    capacity = 32
    fill, ranks = defaultdict(dict), Counter()
    for length, lo, hi, first, offset in packing.plan_best_fit(histogram, capacity):
        assert lo == ranks[length]
        ranks[length] = hi
        for r in range(lo, hi):
            assert offset not in fill[first + r - lo]
            fill[first + r - lo][offset] = length
    assert ranks == Counter(histogram)
    for places in fill.values():
        at = 0
        for offset in sorted(places):
            assert offset == at
            at += places[offset]
        assert at <= capacity
    total = sum(k * v for k, v in histogram.items())
    assert len(fill) <= max(-(-total // capacity), 1) * 1.7 + 1


def test_best_fit_is_tight():
    assert len({p[3] for p in packing.plan_best_fit({7: 1, 5: 1, 3: 1, 2: 1}, 10)}) <= 2
    plan = packing.plan_best_fit({600: 10, 424: 10}, 1024)
    assert sum(hi - lo for _, lo, hi, _, offset in plan if offset == 0) == 10


def test_fast_ids_equal_the_tokenizer():
    texts = ["", " ", "  x\n\n y\t z 'll 12 ½ 漢字 🙂", "<|endoftext|> a <|endoftext|>", "a\x00b́", "Ünï  \r\n  code's" * 30]
    whole = Tokenizer.from_file(PATH)
    assert [list(a) for a in packing.encode(texts, PATH)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    other = public_tokenizers.path("word_bpe_49k.json")
    slow = Tokenizer.from_file(other)
    assert [list(a) for a in packing.encode(texts[:3], other)] == [slow.encode(t, add_special_tokens=False).ids for t in texts[:3]]


def check(rows, docs, capacity):
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        for k, end in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, end - capacity) if k else 0
            want[d, k, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def test_pack_keeps_all_ids(spark, odd_docs):
    rows = packing.pack(odd_docs, PATH, capacity=64).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 64)
    assert n <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_pack_nothing(spark, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    from auger.llm.queries import QUERIES
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op1_best_fit_packing"](spark, sf).collect()
    n = check(rows, docs, 1024)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=10))
def test_plan_needs_as_many_sequences_as_best_fit_decreasing_of_documents(histogram):
    capacity, free = 40, []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    plan = packing.plan_best_fit(histogram, capacity)
    assert len({first + k for _, lo, hi, first, _ in plan for k in range(hi - lo)}) == len(free)
