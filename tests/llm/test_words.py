import re

import numpy as np

from auger.llm import words as W


def test_words_match_a_regular_expression():
    texts = ["The cat, the CAT! naïve Ünter_x 12,5", None, "", "a b c d e f"]
    got = W.Words(texts)
    for i, t in enumerate(texts):
        ws = [(m.start(), m.end()) for m in re.finditer(r"\w+", t or "")]
        assert list(zip(got.start[got.off[i]:got.off[i + 1]], got.end[got.off[i]:got.off[i + 1]])) == ws
    low = re.findall(r"\w+", texts[0].lower())
    h = got.hash[:len(low)]
    assert (h[0] == h[2]) and (h[1] == h[3]) and len(set(h)) == len(set(low))


def test_hashes_do_not_depend_on_neighbours_or_cuts(monkeypatch):
    text = " ".join(f"tok{i % 97}" for i in range(5000))
    whole = W.Words(["x y", text, "z"])
    monkeypatch.setattr(W, "CHUNK", 211)
    cut = W.Words([text])
    assert (whole.hash[whole.off[1]:whole.off[2]] == cut.hash).all()
    assert (whole.start[whole.off[1]:whole.off[2]] == cut.start).all()


def test_one_word_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 50)
    got = W.Words(["a " + "b" * 300 + " c"])
    assert len(got.hash) == 3


def test_shingles_equal_for_equal_words_only():
    w = W.Words(["a b c d e f", "zz a b c d e f", "a b", "a b", ""])
    s, off = W.shingles(w.hash, w.off)
    assert list(np.diff(off)) == [2, 3, 1, 1, 0]
    assert (s[0:2] == s[3:5]).all() and s[5] == s[6] and len(set(s)) == 4


def test_kinds():
    w = W.Words(["We met John Smith. Then 12 kg"], kinds=True)
    assert list(np.flatnonzero(w.name)) == [2, 3] and list(np.flatnonzero(w.number)) == [5]
