"""Alignment of two tokenizers over the same bytes: groups of tokens between common cuts, and links.

Both tokenizers read ``" " + text``: one of the ``tokenizers`` library (A, byte level), one of
``sentencepiece`` (B, which adds the space itself; byte fallback). Where a token of A and one of B end at the
same byte both sequences are cut; the tokens between two cuts are a group, and each A token of a group is
linked to each of its B tokens.

* **Coarse cuts** are the spans that the libraries report: character offsets of A, byte spans of B.
* **Refined cuts**: a span covers whole characters. Where it is not as long as the token's decoded bytes (a
  part of a multibyte character, a byte-fallback token) the token ends as many bytes after the one before.
* Neither tokenizer has tokens over the edges of words (of its own kind), so each is applied once to every
  different word of a slice of texts, kept per Python worker in a table of bounded size, and the rest is
  array arithmetic on whole slices. A model of which this does not hold is refused.
* A link's count is the number of documents that hold its pair of ids. Documents carry their different pairs
  with the times they hold them; no pair of occurrences is listed. Counts of the ``FREQUENT`` most
  common pairs, at most that many, go to all tasks, so no frequent pair is a key of a join; pairs below
  are joined with the table of counts.

A document whose joined A or B bytes are not those of ``" " + text`` has no tokens (all zeros, no groups), nor
has a null or empty text. Repeated rows are documents of their own; null ids stay null; other columns are
ignored.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.bpe import Pretokens, byte_chars, token_bytes
from auger.llm.words import code_points, text_batches
from auger.session import write_scratch

FREQUENT = 1 << 20
WORDS, LONG_WORD = 600_000, 256  # kept per worker: words, and characters of one
BYTES = 400_000  # of text handled at once
DIRECT = 64  # pairs of a group that are listed before equal ones are summed

ALIGNED = ("doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "a array<int>, b array<int>, times array<long>")


def byte_sizes(begin: np.ndarray, end: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """The bytes of each token: its span's where the span holds just its bytes, else as many as it decodes to."""
    return np.where(end - begin == decoded, end - begin, decoded)


class Numbers(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Side:
    """One tokenizer, and the tokens of the words it has met: ids, byte sizes, and whether their bytes
    are the word's."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.entry = np.empty(0, dtype=np.int32)  # of a word's number in the table of words; -1: not met here
        self.ids, self.sizes, self.first, self.right = array("i"), array("i"), array("q", [0]), bytearray()
        self.long = False  # a long word is among them

    def entries(self, words: list[str], at: np.ndarray, n_words: int) -> np.ndarray:
        """The entry of each word, given the words' numbers; new ones are tokenised."""
        if n_words > len(self.entry):
            self.entry = np.concatenate((self.entry, np.full(n_words, -1, dtype=np.int32)))
        new, place = np.unique(at[self.entry[at] < 0], return_index=True)
        place = np.flatnonzero(self.entry[at] < 0)[place]
        for lo in range(0, len(new), 10_000):
            n = len(self.right)
            self._learn([words[i] for i in place[lo:lo + 10_000].tolist()])
            self.entry[new[lo:lo + 10_000]] = np.arange(n, len(self.right))
        return self.entry[at]

    def _learn(self, new: list[str]) -> None:
        ids, spans, n = self.tokens(new)
        sizes = byte_sizes(spans[:, 0], spans[:, 1], self.decoded[ids])
        raw = [w.encode() for w in new]
        lengths, last = np.array(list(map(len, raw))), np.cumsum(n)
        run = np.append(0, np.cumsum(sizes))
        right = run[last] - run[last - n] == lengths
        entries = list(map(self.bytes.__getitem__, ids.tolist()))
        if not right.all() or b"".join(entries) != b"".join(raw):
            for k, (a, b) in enumerate(zip((last - n).tolist(), last.tolist())):
                right[k] &= b"".join(entries[a:b]) == raw[k]
        self.first.frombytes((last + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        self.right.extend(right.tobytes())
        self.long |= bool((lengths > LONG_WORD).any())

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte sizes of all tokens of a sequence of words, and the words' numbers of tokens."""
        first = np.frombuffer(self.first, dtype=np.int64)
        n = first[words + 1] - first[words]
        at = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.frombuffer(self.ids, dtype=np.int32)[at], np.frombuffer(self.sizes, dtype=np.int32)[at].astype(np.int64), n


class SideA(Side):
    """A byte-level tokenizer of the ``tokenizers`` library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        chars = byte_chars()
        self.bytes = {i: token_bytes(t, chars) for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.decoded = np.array([len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)])
        self.cut = Pretokens(self.whole)

    def tokens(self, words):
        e = self.whole.encode(words, is_pretokenized=True, add_special_tokens=False)  # offsets count within each word
        of = np.array(e.word_ids, dtype=np.int64)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        chars = code_points("".join(words))
        at = np.append(0, np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)))
        spans = at[spans + np.append(0, np.cumsum(list(map(len, words))))[of][:, None]]
        return np.array(e.ids, dtype=np.int32), spans, np.bincount(of, minlength=len(words))


class SideB(Side):
    """A ``sentencepiece`` model with byte fallback. Words are spaces and then letters and digits, or other
    characters (superscript digits with them); no piece may hold characters of two words, or a line end."""

    cut = re.compile(r" *[^\W_¹²³]+| *(?:[^\w ]|[_¹²³])+| +").findall

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor
        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.decoded = np.array(list(map(len, self.bytes)))
        probe = "  a  bﬁ½\n "
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if (b"".join(self.bytes[i] for i in m.encode(probe)) != f" {probe}".encode()
                or any("\n" in p or len(SideB.cut(p)) > 1 for p in plain)):
            raise ValueError(f"{path} normalises texts or has pieces that reach over words")

    def tokens(self, words):
        # in one text, parted by line ends, which are no part of any piece
        lengths = np.array([len(w.encode()) for w in words])
        starts = np.cumsum(lengths + 1) - lengths
        pieces = self.model.encode("\n" + "\n".join(words), return_type="proto").pieces
        found = np.array([(p.id, p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 3)
        of = np.searchsorted(starts, found[:, 1], side="right") - 1
        inside = (of >= 0) & (found[:, 1] < (starts + lengths)[of])
        return found[inside, 0].astype(np.int32), found[inside, 1:], np.bincount(of[inside], minlength=len(words))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.number = Numbers()  # of the words of both
        self.width = len(self.b.bytes)
        # ends of ids in the text of groups: within and at the end of a group's A part, then of its B part
        na = max(self.a.bytes) + 1
        self.marks = ([f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)]
                      + [f"{i}," for i in range(self.width)] + [f"{i};" for i in range(self.width)])
        self.base = (0, na, 2 * na, 2 * na + self.width)

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Per text ``n_a, n_b, n_groups, n_links, groups``; the different pairs of ids of text ``i``, and the
        times it holds them, are ``a, b, times`` from ``off[i]`` to ``off[i + 1]``."""
        if len(self.number) >= WORDS or self.a.long or self.b.long:  # long words hold much and seldom come again
            self.number.clear()
            self.a.reset()
            self.b.reset()
        n = len(texts)
        full = [f" {t}" if t else "" for t in texts]
        sides = []
        for side in (self.a, self.b):
            words = [side.cut(t) if t else [] for t in full]
            flat = [w for ws in words for w in ws]
            at = side.entries(flat, np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat)), len(self.number))
            doc = np.repeat(np.arange(n), list(map(len, words)))
            wrong = ~np.frombuffer(side.right, dtype=bool)[at]
            sides.append((side, at, doc, np.bincount(doc[wrong], minlength=n) if len(doc) else np.zeros(n)))
        use = np.array([bool(t) for t in texts], dtype=bool) & (sides[0][3] + sides[1][3] == 0)
        ids, ends, docs = [], [], []
        for side, at, doc, _ in sides:
            keep = use[doc]
            i, size, n_tokens = side.gather(at[keep])
            ids.append(i.astype(np.int64))
            ends.append(np.cumsum(size))
            docs.append(np.repeat(doc[keep], n_tokens))
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        size = [np.bincount(g, minlength=len(cuts)) for g in group]
        group_doc = docs[0][np.cumsum(size[0]) - 1]
        out = {"n_a": np.bincount(docs[0], minlength=n), "n_b": np.bincount(docs[1], minlength=n),
               "n_groups": np.bincount(group_doc, minlength=n)}
        links = np.zeros(n, dtype=np.int64)
        np.add.at(links, group_doc, size[0] * size[1])
        out["n_links"] = links
        out["groups"] = self._text(ids, group, docs, n)
        return out | self._pairs(ids, size, group_doc, n)

    def _text(self, ids, group, docs, n: int) -> list[str]:
        marks, place = [], []
        for k in (0, 1):
            last = np.append(group[k][1:] != group[k][:-1], True) if len(ids[k]) else np.empty(0, dtype=bool)
            marks.append(ids[k] + np.where(last, self.base[2 * k + 1], self.base[2 * k]))
            place.append(2 * group[k] + k)
        order = np.argsort(np.concatenate(place), kind="stable")
        parts = list(map(self.marks.__getitem__, np.concatenate(marks)[order].tolist()))
        stop = np.cumsum(np.bincount(docs[0], minlength=n) + np.bincount(docs[1], minlength=n)).tolist()
        return ["".join(parts[lo:hi])[:-1] for lo, hi in zip([0, *stop], stop)]

    def _pairs(self, ids, size, group_doc, n: int) -> dict[str, np.ndarray]:
        first = [np.cumsum(s) - s for s in size]
        n_pairs = size[0] * size[1]
        few = np.flatnonzero(n_pairs <= DIRECT)
        g = np.repeat(few, n_pairs[few])
        k = np.arange(len(g)) - np.repeat(np.cumsum(n_pairs[few]) - n_pairs[few], n_pairs[few])
        keys = [ids[0][first[0][g] + k // size[1][g]] * self.width + ids[1][first[1][g] + k % size[1][g]]]
        doc, times = [group_doc[g]], [np.ones(len(g), dtype=np.int64)]
        for g in np.flatnonzero(n_pairs > DIRECT):
            (a, na), (b, nb) = (np.unique(ids[s][first[s][g]:first[s][g] + size[s][g]], return_counts=True) for s in (0, 1))
            keys.append((a[:, None] * self.width + b).ravel())
            times.append((na[:, None] * nb).ravel())
            doc.append(np.full(len(keys[-1]), group_doc[g]))
        key, doc, times = np.concatenate(keys), np.concatenate(doc), np.concatenate(times)
        order = np.lexsort((key, doc))
        key, doc, times = key[order], doc[order], times[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
        return {"a": key[new] // self.width, "b": key[new] % self.width,
                "times": np.add.reduceat(times, new) if len(new) else times,
                "off": np.searchsorted(doc[new], np.arange(n + 1))}


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``ALIGNED``. ``groups`` has the ids of each group,
    ``a1,a2|b1;a3|b2,b3``; ``a, b, times`` are the different linked pairs and how often each is linked;
    ``row`` numbers the rows."""

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_batches(batch, BYTES):
                out = aligner(path_a, path_b).align(part.column("text").to_pylist())
                off = pa.array(out["off"], pa.int32())
                lists = {k: pa.ListArray.from_arrays(off, pa.array(out[k], t))
                         for k, t in (("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64()))}
                plain = {k: pa.array(out[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}
                cols = {"doc_id": part.column("doc_id").cast(pa.int64()), "row": pa.array(np.arange(row, row + len(part)))}
                cols |= plain | {"groups": pa.array(out["groups"], pa.string())} | lists
                yield pa.RecordBatch.from_pydict(cols)
                row += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: how many documents of ``aligned`` hold each pair, and whether no other pair of
    its A id has more."""

    def run(batches):
        key, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        rows = lambda: pa.RecordBatch.from_pydict({"a": (key >> 32).astype(np.int32), "b": key.astype(np.int32), "n": n})
        for batch in batches:
            found = np.concatenate((key, _flat(batch, "a").astype(np.int64) << 32 | _flat(batch, "b")))
            n = np.concatenate((n, np.ones(len(found) - len(n), dtype=np.int64)))
            order = np.argsort(found, kind="stable")
            found = found[order]
            new = np.flatnonzero(np.append(True, found[1:] != found[:-1])[:len(found)])
            key, n = found[new], np.add.reduceat(n[order], new) if len(new) else n
            if len(key) > 1_000_000:
                yield rows()
                key, n = key[:0], n[:0]
        yield rows()

    counts = (aligned.select("a", "b").mapInArrow(run, "a int, b int, n long")
              .groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = write_scratch(counts, "pair-counts")
    # one row per id of A: at most its vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` (links whose pair is ``best``) and ``count_sum`` (the sum
    of ``n`` over links). Both tables must be written ones."""
    spark = aligned.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = -(-total // frequent)  # at most `frequent` pairs have so many
    common = counts.where(F.col("n") >= least).toArrow()
    key = common.column("a").to_numpy().astype(np.int64) << 32 | common.column("b").to_numpy()
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], common.column("n").to_numpy()[order],
                                          common.column("best").to_numpy(zero_copy_only=False)[order]))

    def run(batches):
        keys, counts_, best = known.value
        for batch in batches:
            a, b, times = (_flat(batch, k) for k in ("a", "b", "times"))
            key = a.astype(np.int64) << 32 | b
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            row = np.repeat(np.arange(len(batch)), batch.column("a").value_lengths().to_numpy(zero_copy_only=False))
            sums = np.zeros((2, len(batch)), dtype=np.int64)
            w = times[hit]
            np.add.at(sums[0], row[hit], w * best[at[hit]])
            np.add.at(sums[1], row[hit], w * counts_[at[hit]])
            off = pa.array(np.searchsorted(row[~hit], np.arange(len(batch) + 1)), pa.int32())
            rest = {k: pa.ListArray.from_arrays(off, pa.array(v[~hit])) for k, v in (("a", a), ("b", b), ("times", times))}
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "n_best": sums[0], "count_sum": sums[1]} | rest)

    pairs = "a array<int>, b array<int>, times array<long>"
    scored = aligned.select("row", "a", "b", "times").mapInArrow(run, f"row long, n_best long, count_sum long, {pairs}")
    scored = write_scratch(scored, "scored-links")
    rare = (scored.where(F.size("a") > 0).select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
            .select("row", "p.*").join(counts.where(F.col("n") < least), ["a", "b"])
            .select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"),
                    (F.col("times") * F.col("n")).alias("count_sum")))
    sums = (scored.select("row", "n_best", "count_sum").unionByName(rare)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return aligned.drop("a", "b", "times").join(sums, "row").drop("row")
