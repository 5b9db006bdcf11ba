import random
import re

import numpy as np
import pytest

from auger.llm import passages


def word_list(text):
    return re.findall(r"\w+", (text or "").lower())


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(5000)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(55), text(80), text(300)]
    rows, planted = [], []
    for d in range(n):
        w = text(rng.randrange(0, 400))
        if d % 3:
            p = rng.randrange(3)
            at = rng.randrange(len(w) + 1)
            planted.append((d, p, at, at + len(shared[p])))
            w[at:at] = shared[p]
        rows.append((d, " ".join(w)))
    return rows, planted


def test_planted_passages_are_found_and_nothing_else(spark):
    rows, planted = corpus()
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    cover = {}
    for r in got:
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["other_doc"] < r["doc_id"] and r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        words = {d: word_list(t) for d, t in rows}
        sets = [{tuple(w[i:i + 5]) for i in range(a, b - 4)} for w, a, b in (
            (words[r["doc_id"]], r["start_word"], r["end_word"]), (words[r["other_doc"]], r["other_start"], r["other_end"]))]
        assert abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - r["similarity"]) < 1e-9
    first = {}
    for d, p, a, b in planted:
        if p in first:
            assert set(range(a, b)) <= cover[d]
            assert len(cover.pop(d) - set(range(a, b))) <= 12
        first.setdefault(p, d)
    assert not cover  # neither first copies nor clean documents


def test_near_copies_of_a_passage(spark):
    rng = random.Random(4)
    base = [f"b{rng.randrange(9999)}" for _ in range(200)]
    other = list(base)
    for i in (40, 90, 150):
        other[i] = "changed"
    del other[120:123]
    rows = [(1, " ".join(["x1 y1"] + base)), (2, " ".join(other + ["tail"])), (3, " ".join(f"c{i}" for i in range(300)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {2}
    assert len(set().union(*(range(r["start_word"], r["end_word"]) for r in got))) > 180


def test_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2 ** 63, 700, dtype=np.int64).astype(np.uint64)
    off = np.array([0, 30, 330, 700])
    for j, (key, owner, place, _) in enumerate(passages.compact_windows(s, off)):
        v = passages.mix(s ^ passages._SEEDS[j])
        want = set()
        for t in range(3):
            part = v[off[t]:off[t + 1]] >> np.uint64(24)
            for c in range(len(part)):
                lo = c
                while lo > 0 and part[lo - 1] > part[c]:
                    lo -= 1
                hi = c
                while hi + 1 < len(part) and part[hi + 1] >= part[c]:
                    hi += 1
                if hi - lo + 1 >= passages.WIDTH:
                    want.add((t, c, max(lo, c - passages.WIDTH + 1), min(hi, c + passages.WIDTH - 1)))
        c, left, right, _ = passages._place(place)
        assert set(zip(owner, c, left, right)) == want


def test_hot_passage_is_salted(spark, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "LEAST_HOT", 3)
    monkeypatch.setattr(passages, "HOT_SHARE", 10 ** 6)
    rows, planted = corpus(seed=9)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cover = {}
    for r in got:
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    first = {}
    for d, p, a, b in planted:
        if p in first:
            assert set(range(a, b)) <= cover[d]
        first.setdefault(p, d)


def test_removal_keeps_one_copy(spark):
    rows, planted = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in passages.remove_passages(docs, passages.repeated_passages(docs)).collect()}
    marked = {d for d, p, _, _ in planted if d != min(x for x, q, _, _ in planted if q == p)}
    for d, t in rows:
        if d not in marked:
            assert out[d]["text"] == t
        elif d in out:
            assert len(word_list(out[d]["text"])) < len(word_list(t)) and out[d]["n_chars"] == len(out[d]["text"])


def test_odd_rows(spark, odd_docs, no_docs):
    got = passages.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in got} >= {10, 11} and 9 not in {r["doc_id"] for r in got}
    back = passages.remove_passages(odd_docs, passages.repeated_passages(odd_docs))
    assert back.columns == odd_docs.columns and back.count() >= odd_docs.count() - 3
    assert back.where("doc_id = 10").first()["text"].split() == "before it and after it".split()
    assert passages.repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("threshold", [0.8])
def test_stretches_split_where_words_are_missing(threshold):
    other = np.arange(1000, 1400, dtype=np.uint32)
    own = np.concatenate([other[:120], other[260:]])
    got = passages.stretches(own, other)
    assert sum(b - a for a, b, *_ in got) >= 255 and all(s >= threshold for *_, s in got)


def test_rows_of_one_id_or_without_one_are_documents_of_their_own(spark):
    rng = random.Random(6)
    text = lambda k: " ".join(f"n{rng.randrange(10 ** 6)}" for _ in range(k))
    p, q, s = text(80), text(90), text(70)
    rows = [(None, f"{text(300)} {p} {text(40)}"), (5, f"{text(70)} {p}"), (9, f"{p} {text(90)}"),
            (None, f"{text(130)} {q}"), (None, f"{q} {text(20)}"), (3, f"{text(30)} {s}"), (3, f"{s} {text(200)}")]
    rows += [(None, text(400)) for _ in range(30)] + [rows[0], rows[3], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = passages.repeated_passages(docs)
    got = [(r["doc_id"], r["other_doc"]) for r in found.collect()]
    assert sorted(got, key=str) == [(3, 3), (5, None), (9, None), (None, None)]
    left = [" ".join(word_list(r["text"])) for r in passages.remove_passages(docs.distinct(), found).collect()]
    assert [sum(x in t for t in left) for x in (p, q, s)] == [1, 1, 1]


@pytest.mark.parametrize("length,parts", [
    (50, [(0, 45)]), (50, [(0, 41), (10, 50)]), (50, [(0, 45), (5, 50)]), (60, [(0, 45), (15, 60)]), (60, [(0, 49)]), (52, [(0, 49), (3, 52), (1, 50)])])
def test_smaller_documents_with_parts_of_a_passage_hide_nothing(spark, length, parts):
    rng = random.Random(length + len(parts))
    fresh = lambda k: [f"w{rng.randrange(10 ** 9)}" for _ in range(k)]
    rows, want = [], {}
    for trial in range(60):
        p = fresh(length)
        docs = [fresh(30) + p[a:b] + fresh(30) for a, b in parts]
        for _ in range(2):
            at = rng.randrange(5, 80)
            docs.append(fresh(at) + p + fresh(40))
        ids = [trial * 10 + i for i in range(len(docs))]
        rows += [(i, " ".join(w)) for i, w in zip(ids, docs)]
        want[ids[-1]] = (ids[-2], at)
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, (other, at) in want.items():
        assert any(r["start_word"] <= at and r["end_word"] >= at + length and r["other_doc"] == other for r in got.get(d, [])), d
    assert all(r["end_word"] - r["start_word"] >= 50 for rs in got.values() for r in rs)
