"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitals inside a sentence) and units are replaced by typed placeholders, neighbours of
one type by a single one; all other words are literals in lower case. Windows of ``WINDOW`` template words
with at least ``LITERALS`` literals are hash-joined between documents and benchmark items (an item shorter
than that is one window). Windows at one distance form an occurrence; its slots must be consistent: each
value of the item (a number, a name) stands for one value of the document throughout. So an item is also
found with other numbers and names in it, and text that merely shares a form is not.

An item without such a window (a short question, or one dense in numbers and names) is sought by its plain words:
in windows of ``WINDOW`` words, numbers and names as they are, or as a whole if it is shorter.

Document windows are filtered before the join by a bitmap of the item windows, ``2**MAP_BITS`` bits
whatever the number of items; the join itself compares whole hashes and is planned by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.words import _ODD, Words, mix, text_batches
from auger.session import write_scratch

WINDOW, LITERALS, COVERAGE = 8, 5, 0.5
ALONE = 2  # items of so many words at most are no phrase of their own: they must be all of a document
MAP_BITS = 22
# Units, fixed values.
UNITS = """kg g mg lb lbs oz km m cm mm ft inch inches mile miles yard yards litre litres liter liters ml
hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro
euros cent cents pound pounds percent degree degrees metre metres meter meters gram grams""".split()

_UNIT_HASHES = np.sort(Words([" ".join(UNITS)]).hash)
_PLAIN = np.uint64(0x5D3B1E8F9A7C2461)
_SLOT = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xA5A5A5A5))  # number, name, unit


def templates(texts: list[str | None]):
    """Template words of the texts: token, whether it is a slot, slot value, and offsets by text."""
    return _template_words(Words(texts, kinds=True), len(texts))


def _template_words(w: Words, n_texts: int):
    kind = np.zeros(len(w.hash), dtype=np.int64)
    kind[np.isin(w.hash, _UNIT_HASHES)] = 3
    kind[w.name] = 2
    kind[w.number] = 1
    text = np.repeat(np.arange(n_texts), np.diff(w.off))
    first = np.ones(len(kind), dtype=bool)
    first[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    run = np.zeros(len(kind) + 1, dtype=np.uint64)
    np.cumsum(mix(w.hash + np.arange(len(kind), dtype=np.uint64) - at[np.cumsum(first) - 1].astype(np.uint64)) if len(kind) else w.hash, out=run[1:])
    value = run[np.append(at[1:], len(kind))] - run[at] if len(at) else run[:0]
    slot = kind[at] > 0
    token = np.where(slot, _SLOT[np.maximum(kind[at] - 1, 0)], w.hash[at])
    return token, slot, value, np.searchsorted(text[at], np.arange(n_texts + 1))


def template_windows(token: np.ndarray, slot: np.ndarray, off: np.ndarray, size: int, whole: bool = False):
    """Hash and start of each window of ``size`` template words with enough literals; with ``whole``
    only texts of exactly that length."""
    n = len(token) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    text = np.searchsorted(off, np.arange(n), side="right") - 1
    ok = np.arange(n) + size <= off[text + 1]
    if whole:
        ok &= off[text + 1] - off[text] == size
    slots = np.concatenate(([0], np.cumsum(slot)))
    ok &= size - (slots[size:] - slots[:-size]) >= LITERALS
    at = np.flatnonzero(ok)
    return _hashes(token, at, size), at


def _hashes(token: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    acc = np.full(len(at), size, dtype=np.uint64)
    for j in range(size):
        acc = (acc + token[at + j]) * _ODD[j % len(_ODD)]
    return mix(acc)


def word_windows(words: np.ndarray, off: np.ndarray, size: int, whole: bool = False):
    """Hash and start of each window of ``size`` plain words; with ``whole``, and for ``ALONE`` words at
    most, only texts of exactly that length."""
    at = np.arange(max(len(words) - size + 1, 0))
    text = np.searchsorted(off, at, side="right") - 1
    ok = at + size <= off[text + 1]
    if whole or size <= ALONE:
        ok &= off[text + 1] - off[text] == size
    at = at[ok]
    return _hashes(mix(words ^ _PLAIN), at, size), at


def _emit(id_name: str, sizes: list[int], plain_sizes: list[int], bitmap=None):
    """Windows of documents (with the ``bitmap`` of the items' windows) or of items; of items, plain words
    where there is no template window."""
    def run(batches):
        for batch in batches:
            for b in text_batches(batch):
                w = Words(b.column("text").to_pylist(), kinds=True)
                token, slot, value, t_off = _template_words(w, b.num_rows)
                template_slots, no_slots = np.flatnonzero(slot), np.empty(0, dtype=np.int64)
                none = np.ones(b.num_rows, dtype=bool)  # texts without a template window
                for plain, size in [(False, n) for n in sizes] + [(True, n) for n in plain_sizes]:
                    off, slot_at = (w.off, no_slots) if plain else (t_off, template_slots)
                    whole = bitmap is None and size < WINDOW
                    h, at = word_windows(w.hash, off, size, whole) if plain else template_windows(token, slot, off, size, whole)
                    if bitmap is None:
                        text = np.searchsorted(off, at, side="right") - 1
                        if plain:
                            h, at = h[none[text]], at[none[text]]
                        else:
                            none[text] = False
                    if bitmap is not None and len(h):
                        i = (h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                        hit = (bitmap.value[i >> 3] >> (i & 7)) & 1 == 1
                        h, at = h[hit], at[hit]
                    if not len(h):
                        continue
                    text = np.searchsorted(off, at, side="right") - 1
                    lo, hi = np.searchsorted(slot_at, at), np.searchsorted(slot_at, at + size)
                    slots = [value[slot_at[x:y]].view(np.int64) for x, y in zip(lo, hi)]
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), b.column(id_name).take(rows), b.column("text_key").take(rows),
                         pa.array(at - off[text]), pa.array(np.full(len(h), size, dtype=np.int64)),
                         pa.array((off[1:] - off[:-1])[text]), pa.array(slots, pa.list_(pa.int64())), pa.array(np.full(len(h), plain))],
                        names=["hash", id_name, "text_key", "pos", "size", "words", "slots", "plain"])

    return run


def _schema(id_name: str) -> str:
    return f"hash long, {id_name} long, text_key long, pos long, size long, words long, slots array<long>, plain boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, text_key, item_id, coverage, occurrences, same_values`` of every document and item where
    consistent occurrences cover at least that share of the item's template words (those that some
    window of it can cover), or hold ``WINDOW`` literal words of it in a row, whatever their share. ``same_values``: all slots hold the item's own values; else the item was
    re-parameterised. ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``; other columns are ignored.

    Null and empty texts match nothing; an item with fewer than ``LITERALS`` literals in a row of ``WINDOW``
    template words is found with its own numbers and names only; one of ``ALONE`` words at most where a document has no others.
    Repeated rows and null ids give one pair;
    ``text_key`` hashes the document's text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    items = benchmark.select(F.col("item_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    wanted = write_scratch(items.mapInArrow(_emit("item_id", list(range(LITERALS, WINDOW + 1)), list(range(1, WINDOW + 1))), _schema("item_id")).select(
        "hash", "item_id", F.col("pos").alias("ipos"), "size", F.col("slots").alias("islots"), "words", "plain").distinct(), "item-windows")
    marks = wanted.select(F.col("hash").bitwiseAND((1 << MAP_BITS) - 1).cast("int").alias("i")).distinct().toArrow()  # 2**MAP_BITS at most
    kinds = wanted.select("plain", "size").distinct().orderBy("size").collect()  # a few window lengths
    sizes, plain_sizes = ([r["size"] for r in kinds if r["plain"] == x] for x in (False, True))
    bits = np.zeros(1 << MAP_BITS, dtype=np.uint8)
    bits[marks.column("i").to_numpy()] = 1
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    found = docs.mapInArrow(_emit("doc_id", sizes, plain_sizes, bitmap), _schema("doc_id")).drop("size", "words", "plain").join(wanted, "hash")
    places = F.sequence(F.col("ipos"), F.col("ipos") + F.col("size") - 1)
    pairs = F.arrays_zip(F.col("islots").alias("item"), F.col("slots").alias("doc"))
    by_place = (found.groupBy("doc_id", "text_key", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
                .agg(F.array_distinct(F.flatten(F.collect_set(places))).alias("covered"),
                     F.max(~F.col("plain") & (F.col("size") == WINDOW) & (F.size("islots") == 0)).alias("literal"),
                     F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")))  # one item long at most
    one_each = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    pair = (by_place.where(one_each).groupBy("doc_id", "text_key", "item_id")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("n"), F.count(F.lit(1)).alias("occurrences"), F.max("literal").alias("literal"),
                 F.min(F.forall("pairs", lambda p: p["item"] == p["doc"])).alias("same_values")))
    reach = wanted.groupBy("item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set(places)))).alias("of"))
    return (pair.join(reach, pair["item_id"].eqNullSafe(reach["item_id"])).drop(reach["item_id"])
            .withColumn("coverage", F.col("n") / F.col("of")).where((F.col("coverage") >= coverage) | F.col("literal"))
            .select("doc_id", "text_key", "item_id", "coverage", "occurrences", "same_values"))
