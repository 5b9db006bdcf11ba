import functools
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auger.llm import bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(bpe.tokenizer(PATH).encode(text), dtype="<u4").tolist()


@functools.lru_cache(maxsize=1)
def merges():
    b = bpe.tokenizer(PATH)
    single = {v[0]: k for k, v in b.bytes.items() if len(v) == 1}
    return b, single, {(b.left[k], b.right[k]): k for k in range(len(b.rank)) if b.rank[k] >= 0}


def merged(text):
    """Brute force: the merge of the lowest rank, leftmost first, until none is left."""
    b, single, whole = merges()
    ids = [single[x] for x in text.encode()]
    while True:
        found = [(b.rank[whole[p]], i) for i, p in enumerate(zip(ids, ids[1:])) if p in whole]
        if not found:
            return ids
        i = min(found)[1]
        ids[i:i + 2] = [whole[ids[i], ids[i + 1]]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinrst 'Ééß\n漢🙂0՘", max_size=40))
def test_ids_and_text_equal_the_library(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == ids
    assert bpe.tokenizer(PATH).decode(ids) == WHOLE.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehinorst", max_size=24))
def test_every_prefix_ends_in_its_last_token(word):
    b = bpe.tokenizer(PATH)
    last = b.last_tokens(word.encode())
    for n in range(1, len(word) + 1):
        assert merged(word[:n])[-1] == last[n]


@pytest.mark.parametrize("text", [
    "a" * 20000, " " * 3000 + "x", "ab" * 4000, "é" * 2000, "\r\n" * 500, "x<|endoftext|>  <|endoftext|>y", "<|endoftext|>",
    "a <|endoftext", "\x00\x01\x85　", "''s 'll 'S", "꟎౜1 ꟎"])
def test_long_and_odd_texts(text):
    assert ids_of(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_letters_and_numbers_of_all_code_points():
    for block in range(0x80, 0x20000, 256):
        text = "".join(f"x{chr(c)}{chr(c)} {chr(c)}1{chr(c)}" for c in range(block, block + 256, 3) if not 0xD800 <= c < 0xE000)
        assert ids_of(text) == WHOLE.encode(text, add_special_tokens=False).ids, hex(block)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids_equals_the_library(ids):
    assert bpe.tokenizer(PATH).decode(ids) == WHOLE.decode(ids, skip_special_tokens=False)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_odd_rows(odd_docs, no_docs):
    want = sorted((r["doc_id"] or -1, WHOLE.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in odd_docs.collect())
    for packed in (False, True):
        rows = bpe.decode(bpe.encode(odd_docs, PATH, packed), PATH).collect()
        ids = lambda r: np.frombuffer(r["ids"], dtype="<u4").tolist() if packed else r["ids"]
        assert sorted((r["doc_id"] or -1, ids(r), r["text"]) for r in rows) == want
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_query(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_round_trip"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = WHOLE.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(WHOLE.decode(ids, skip_special_tokens=False).encode()).hexdigest()
