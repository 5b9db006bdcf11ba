import bisect
import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from auger.llm import alignment
from auger.llm.bpe import byte_chars
from auger.session import write_scratch

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHOLE = Tokenizer.from_file(PATHS[0])
WHOLE.encode_special_tokens = True
PIECES = SentencePieceProcessor(model_file=PATHS[1])
CHARS = byte_chars()


def plain(text):
    """Brute force for one text: groups as pairs of lists of ids, from decoded bytes alone."""
    if not text:
        return []
    e = WHOLE.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(CHARS[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for k, side in enumerate((a, b)):
        for (i, _), end in zip(side, ends[k]):
            groups[bisect.bisect_left(cuts, end)][k].append(i)
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts):
    groups = [plain(t) for t in texts]
    links = [Counter((a, b) for x, y in gs for a in x for b in y) for gs in groups]
    count = Counter(p for x in links for p in x)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(x.values()),
             sum(m for p, m in x.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in x.items()),
             hashlib.sha256(written(gs).encode()).hexdigest() if gs else "") for gs, x in zip(groups, links)]


TEXTS = ["", "a", " ", "  ", " a ", "a  b   ", "x\n\n y\t", "漢字仮名🙂🙂‍🙂", "½ﬁ Ünï ‰", "▁a", "a ▁ b", "<|endoftext|> <s> <0x41>", "\x00a\x00",
         "naïve żółw", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "'s 'll", "é" * 40, "日本語 テスト カタカナ", "՘꟎౜", " " * 50 + "x" + " " * 33]


@pytest.mark.parametrize("text", TEXTS)
def test_groups_equal_brute_force(text):
    out = alignment.aligner(*PATHS).align(["zz", text, None, "before"])
    assert out["groups"][1] == written(plain(text))
    assert out["groups"][2] == "" and out["n_a"][2] == 0 and out["groups"][0] == written(plain("zz"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abein 'Ééß\n漢🙂0▁", max_size=30), max_size=4))
def test_slices_equal_brute_force(texts):
    out = alignment.aligner(*PATHS).align(texts)
    for i, t in enumerate(texts):
        groups = plain(t)
        assert out["groups"][i] == written(groups)
        links = Counter((a, b) for x, y in groups for a in x for b in y)
        at = slice(out["off"][i], out["off"][i + 1])
        assert dict(zip(zip(out["a"][at].tolist(), out["b"][at].tolist()), out["times"][at].tolist())) == links


def test_large_groups_are_summed(monkeypatch):
    texts = ["漢字 " * 5 + "🙂🙂", "a" * 50, "żółw " * 9]
    want = alignment.aligner(*PATHS).align(texts)
    monkeypatch.setattr(alignment, "DIRECT", 0)
    got = alignment.aligner(*PATHS).align(texts)
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_tables_that_are_full_start_anew(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 3)
    x = alignment.Aligner(*PATHS)
    for t in ("one two three four", "five six", "one " + "y" * 400, "one two"):
        assert x.align([t])["groups"] == [written(plain(t))]


@pytest.mark.parametrize("frequent", [1 << 20, 20, 1])
def test_scores_equal_brute_force(spark, odd_docs, frequent):
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    aligned = write_scratch(alignment.align(docs, *PATHS), "t")
    counts = write_scratch(alignment.pair_counts(aligned), "t")
    rows = alignment.score_links(aligned, counts, frequent).collect()
    source = docs.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(source, expected([r["text"] for r in source])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], sha(r["groups"])) for r in rows) == want


def test_nothing(spark, no_docs):
    aligned = write_scratch(alignment.align(no_docs, *PATHS), "t")
    counts = write_scratch(alignment.pair_counts(aligned), "t")
    assert counts.count() == 0 and alignment.score_links(aligned, counts).count() == 0


def test_query(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: x for r, x in zip(docs, expected([r["text"] for r in docs]))}
    rows = QUERIES["op12_tokenizer_alignment"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[k] for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want[r["doc_id"]]
