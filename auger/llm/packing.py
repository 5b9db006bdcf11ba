"""Best-fit packing of token sequences by a plan over length counts.

1. Texts are tokenised once per partition; a document of more than ``capacity`` ids is cut into pieces of
   exactly that many, the first taking the rest. While a task writes its pieces it numbers those of equal
   length, so (task, number) ranks them without a sort.
2. The counts of pieces per (length, task) are summed by Spark; only the histogram over lengths, at most
   ``capacity`` numbers, is on the driver.
3. Best fit decreasing over those counts: sequences with the same free space are handled together as a
   range of numbers, so the plan has a few rows per length however many documents there are.
4. A piece takes the slot of its rank: it joins the plan on its length and the range of ranks.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.llm.words import text_batches
from auger.session import write_scratch

CAPACITY = 1024
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long, ids array<int>"


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> ids of the tokenizer in ``path``.

    A byte-level BPE whose merges are in the order of their ids is the same map as a table of ranks, which
    a faster library applies. Other tokenizers, and texts that hold one of the tokenizer's added tokens,
    go through ``tokenizers`` itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    slow = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return slow
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][m] for m in merged]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    words = {t: i for t, i in model["vocab"].items() if t not in added}
    if made != sorted(set(made)) or len(made) + 256 != len(words):
        return slow
    ranks = {bytes(byte[c] for c in t): i for t, i in words.items()}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [slow([t])[0] if any(a in t for a in added) else fast.encode_ordinary(t) for t in texts]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(ids, dtype="<u4") for ids in _encoder(path)(texts)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece of each document: ``PIECE``; ``ids`` is null unless ``with_ids``.

    ``docs`` needs ``doc_id`` and ``text``; a null or empty text is the end id alone. Repeated rows are
    packed as often as they occur. Other columns are ignored."""

    def cut(batches):
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in text_batches(batch, 1_000_000):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "number", "ids")}
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts, tokenizer)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    ends = range(((len(ids) - 1) % capacity) + 1, len(ids) + 1, capacity)
                    start = 0
                    for k, end in enumerate(ends):
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(start)
                        out["length"].append(end - start)
                        out["ids_crc32"].append(zlib.crc32(ids[start:end].tobytes()))
                        out["number"].append(int(seen[end - start]))
                        out["ids"].append(ids[start:end] if with_ids else None)
                        seen[end - start] += 1
                        start = end
                n = len(out["doc_id"])
                types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int32()) if k == "task" else pa.array(out[k], types.get(k, pa.int64()))
                     for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids")],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts. Rows (length, first rank, end rank, first sequence, offset): the
    pieces of that length with ranks in the range go to that many sequences from the first on."""
    plan = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (first sequence, number)
    spaces: list[int] = []  # the keys of free, ascending

    def put(space: int, first: int, n: int) -> None:
        if space:
            if space not in free:
                bisect.insort(spaces, space)
            free.setdefault(space, []).append((first, n))

    opened = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):  # none fits: open sequences of this length alone
                each = capacity // length
                n = -(-left // each)
                put(capacity, opened, n)
                opened += n
                continue
            space = spaces[at]
            first, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            take = min(n, left)
            if take < n:
                put(space, first + take, n - take)
            plan.append((length, rank, rank + take, first, capacity - space))
            put(space - length, first, take)
            rank, left = rank + take, left - take
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table, see :func:`pack`) with ``sequence_id`` and ``offset``."""
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = cut.sparkSession.createDataFrame(
        plan_best_fit(histogram, capacity) or [(0, 0, 0, 0, 0)],
        "length long, rank_from long, rank_to long, first_sequence long, offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = cut.join(starts, ["length", "task"]).withColumn("rank", F.col("first_rank") + F.col("number"))
    # the plan has a few rows per length (lengths are at most `capacity`), whatever the number of pieces
    return (ranked.join(F.broadcast(plan), "length").where("rank >= rank_from and rank < rank_to")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
                    "offset", "ids"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and ``ids`` (if asked for)."""
    cut = write_scratch(pieces(docs, tokenizer, capacity, end_id, with_ids), "pack-pieces")
    out = place(cut, capacity)
    return out if with_ids else out.drop("ids")
