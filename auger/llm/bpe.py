"""Byte-level BPE by dynamic programming over prefixes: exact ids in time linear in the text.

Merging from the bottom up is not local: a byte more can change tokens before it. But for a list of merges
in which every part is made before the whole, the encoding of a text ends in one token, and what is
before it is the encoding of that shorter prefix. So one number per prefix is enough, its last token:

* An Aho-Corasick automaton over the vocabulary gives, at each byte, the tokens that are suffixes of the
  prefix that ends there.
* Exactly one of them is compatible with the last token of the prefix before it: no merge would have
  joined the two across their border before both were complete (:meth:`ByteBpe.apart`).
* Back-pointers (the length of each last token) give the ids from the end to the start.

Texts are cut into words by the tokenizer's own pattern first. A word's ids are kept per Python worker, in
a table of bounded size. Decoding joins the bytes of the ids.

A null text counts as empty: no ids, empty decoded text. Strings of added tokens within a text become their
ids, as the library does. Repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.words import text_batches

WORDS, PAIRS = 600_000, 500_000  # entries kept per worker; more only cost time again
LONG_WORD = 256  # characters; longer words are not kept
BYTES = 1_000_000  # of text handled at once


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes(token: str, chars: dict[str, int]) -> bytes:
    if all(c in chars for c in token):
        return bytes(chars[c] for c in token)
    return token.encode()


class Pretokens:
    """Cuts texts into words as a byte-level tokenizer of the ``tokenizers`` library does.

    The pattern runs in ``regex``. Libraries differ in the Unicode version of their letters and numbers, so
    each character beyond ASCII is compared once; a text with one that differs is cut by the library."""

    def __init__(self, whole):
        import regex
        from public_tokenizers import PATTERN
        self.cut, self.library = regex.compile(PATTERN).findall, whole.pre_tokenizer.pre_tokenize_str
        self.finditer = regex.compile(PATTERN).finditer
        self.same, self.other = set(map(chr, range(128))), set()

    def _agree(self, c: str) -> bool:
        probe = f"a{c}{c} b{c}1{c}!{c}"
        return [m.span() for m in self.finditer(probe)] == [span for _, span in self.library(probe)]

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            chars = set(text)
            for c in chars - self.same - self.other:
                (self.same if self._agree(c) else self.other).add(c)
            if not self.other.isdisjoint(chars):
                return [text[a:b] for _, (a, b) in self.library(text)]
        return self.cut(text)


class ByteBpe(dict):
    """The tokenizer in a file of the ``tokenizers`` library; as a dict, the ids of words as bytes."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        unsupported = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or unsupported
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        chars, vocab = byte_chars(), model["vocab"]
        self.bytes = {i: token_bytes(t, chars) for t, i in vocab.items()} | {t["id"]: token_bytes(t["content"], chars) for t in added}
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        n = max(self.bytes) + 1
        self.size = [len(self.bytes.get(i, b"")) for i in range(n)]
        self.left, self.right, self.rank, self.merge = [-1] * n, [-1] * n, [-1] * n, {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.rank[k] >= 0 or self.rank[i] < 0 < self.size[i] - 1 or self.rank[j] < 0 < self.size[j] - 1:
                raise ValueError(f"{path}: merge {r} has a part that is made later, or makes a token twice")
            self.left[k], self.right[k], self.rank[k] = i, j, r
            self.merge[i << 32 | j] = r
        self.pairs: dict[int, bool] = {}
        tokens = ahocorasick.Automaton()
        own = [True] * n  # whether the token is the encoding of its own bytes
        for t, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            if self.rank[i] >= 0:
                a, b = self.left[i], self.right[i]
                own[i] = own[a] and own[b] and self.apart(a, b, self.rank[i])
            if own[i] and (self.rank[i] >= 0 or self.size[i] == 1):
                tokens.add_word(self.bytes[i].decode("latin-1"), i)
        tokens.make_automaton()
        self.suffixes = tokens.iter
        self.words = Pretokens(Tokenizer.from_file(path))

    def apart(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether no merge of a rank less than ``below`` joins the end of ``a`` with the start of ``b``.

        Undoes the merges at the border, the latest first. What stands at the border before a merge was
        there until then, so a merge of the two that comes earlier would have been made. Of equal
        merges the one further left goes first."""
        rank, merge = self.rank, self.merge
        while True:
            joint = merge.get(a << 32 | b)
            if joint is not None and joint < below:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, below = self.right[a], min(below, ra)
            else:
                b, below = self.left[b], min(below, rb + 1)

    def last_tokens(self, word: bytes) -> array:
        """The last token of each prefix of ``word``; place 0 is the empty prefix."""
        last, size, pairs = array("i", [-1]) * (len(word) + 1), self.size, self.pairs
        if len(pairs) >= PAIRS:
            pairs.clear()
        for end, token in self.suffixes(word.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - size[token]
                if not start:
                    last[end + 1] = token
                    continue
                pair = last[start] << 32 | token
                apart = pairs.get(pair)
                if apart is None:
                    apart = pairs[pair] = self.apart(last[start], token)
                if apart:
                    last[end + 1] = token
        return last

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        last, size = self.last_tokens(raw), self.size
        ids, at = array("I"), len(raw)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        out = np.asarray(ids, dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, self.words(text)))
        parts = self.split(text)
        return b"".join(self.added[p] if i % 2 else b"".join(map(self.__getitem__, self.words(p))) for i, p in enumerate(parts))

    def decode(self, ids) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs`` (``doc_id, text``). The ids are an array of int or, ``packed``,
    binary: little-endian unsigned 32-bit integers."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in text_batches(batch, BYTES):
                raw = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                if packed:
                    ids = pa.array(raw, pa.binary())
                else:
                    ends = np.cumsum([0] + [len(r) // 4 for r in raw])
                    flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` for each row of ``encoded`` (``doc_id, ids`` of either form); null ids give an
    empty text."""
    packed = encoded.schema["ids"].dataType.typeName() == "binary"

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = part.column("ids").to_pylist()
                if packed:
                    ids = [np.frombuffer(i or b"", dtype="<u4").tolist() for i in ids]
                texts = pa.array([bpe.decode(i or ()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        run, f"doc_id long, ids {'binary' if packed else 'array<int>'}, text string")
