"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of lower-cased texts (padded by one blank) in ``2**bits`` slots per
language, on a bounded sample: of each language at most about ``per_lang`` different texts, each once, those with
the smallest hashes, so the sample depends on the rows alone. Counts are summed by Spark; the slots x
languages matrix of log probabilities is the only thing that reaches the driver and is broadcast
(a quarter of a MB per language).

Scoring reads every whole text in batches: a sparse matrix of the batch's texts by their different slots,
with counts, times the matrix of log probabilities, in blocks of ``BLOCK_CELLS`` products, so memory does not grow
with the languages. The score is the posterior of the best language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.words import CHUNK, code_points, fold, mix, text_batches

BLOCK_CELLS = 1 << 21
UNKNOWN = "und"


def _slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the texts, which follow each other with blanks between, and the place of
    each text's first n-gram."""
    low = fold(code_points(" " + " ".join(texts) + " "))[0].astype(np.uint64)
    off = np.cumsum([0] + [len(t) + 1 for t in texts])
    a, b, c = low[:-1], low[1:], np.append(low[2:], np.uint64(32))
    keep = np.uint64((1 << bits) - 1)
    one = mix(b) & keep
    two = mix(a * np.uint64(0x110000) + b + np.uint64(1 << 50)) & keep
    three = mix((a * np.uint64(0x110000) + b) * np.uint64(0x110000) + c + np.uint64(1)) & keep
    return np.stack([one, two, three], axis=1).astype(np.int64), off


def _parts(text: str):
    for i in range(0, len(text), CHUNK):
        yield text[i:i + CHUNK]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 8000, bits: int = 16,
        alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the ``2**bits x languages`` matrix of log probabilities; its last row
    holds the log priors. Rows with null text or language, or without a letter, teach nothing; copies teach once."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.select("lang", F.xxhash64("text")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1, 0), dtype=np.float32)
    share = rows.sparkSession.createDataFrame(
        [(x, i, min(1.0, per_lang / counts[x])) for i, x in enumerate(langs)], "lang string, k int, share double")
    sample = (rows.join(F.broadcast(share), "lang")
              .where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
              .select("text", "k").distinct())
    n_lang, n_slots = len(langs), 1 << bits

    def count(batches):
        total = np.zeros((n_lang, n_slots), dtype=np.int64)
        docs = np.zeros(n_lang, dtype=np.int64)
        for batch in batches:
            for t, k in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist()):
                if has_letter(t):
                    docs[k] += 1
                    for part in _parts(t):
                        slots, _ = _slots([part], bits)
                        total[k] += np.bincount(slots[:-1].ravel(), minlength=n_slots)
        k, s = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k, np.arange(n_lang)]), pa.int32()),
             pa.array(np.concatenate([s, np.full(n_lang, -1)]), pa.int32()),
             pa.array(np.concatenate([total[k, s], docs]), pa.int64())], names=["k", "slot", "n"])

    cells = (sample.mapInArrow(count, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n"))
             .toArrow())  # at most a row per slot and language
    k, s, n = (cells.column(c).to_numpy() for c in ("k", "slot", "n"))
    table = np.full((n_slots + 1, n_lang), alpha)
    table[s, k] += n  # slot -1: the row of the priors
    table[:-1] /= table[:-1].sum(axis=0)
    table[-1] /= table[-1].sum()
    return langs, np.log(table).astype(np.float32)


def add_log_likelihoods(total: np.ndarray, texts: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> None:
    """Add to the rows ``texts`` (ascending) of ``total`` the weights of their slots: counts times weights."""
    bits = (len(weights) - 1).bit_length() - 1
    cell, n = np.unique(texts << bits | slots, return_counts=True)
    step = max(1, BLOCK_CELLS // weights.shape[1])
    for at in range(0, len(cell), step):
        row, slot = cell[at:at + step] >> bits, cell[at:at + step] & ((1 << bits) - 1)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        products = weights[slot].astype(np.float64) * n[at:at + step, None]
        total[row[first]] += np.add.reduceat(products, first, axis=0)


def predict(df: DataFrame, langs: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``. Null texts and texts without a letter, and every text if
    nothing was learned, get ``und`` and 0. Ties go to the first language by name."""
    keys = [c for c in df.columns if c not in ("lang_pred", "score")]
    model = df.sparkSession.sparkContext.broadcast((langs, table))
    out = df.select(*[F.col(f"`{c}`") for c in keys]).schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        names, weights = model.value
        bits = (len(weights) - 1).bit_length() - 1
        for batch in batches:
            for part in text_batches(batch.rename_columns([("text" if c == text else "\0" + c) for c in batch.schema.names]), 500_000):
                texts = part.column("text").to_pylist()
                total = np.tile(weights[-1].astype(np.float64), (len(texts), 1))
                known = np.array([bool(names) and has_letter(t) for t in texts], dtype=bool)
                short = np.array([i for i in np.flatnonzero(known) if len(texts[i]) <= CHUNK], dtype=np.int64)
                if len(short):
                    slots, off = _slots([texts[i] for i in short], bits)
                    size = np.diff(np.append(off[:-1], len(slots)))  # the last text takes the last gram
                    add_log_likelihoods(total, np.repeat(short, 3 * size), slots.ravel(), weights)
                for i in np.flatnonzero(known):
                    if len(texts[i]) > CHUNK:
                        for piece in _parts(texts[i]):
                            slots = _slots([piece], bits)[0][:-1].ravel()
                            add_log_likelihoods(total, np.full(len(slots), i), slots, weights)
                best, prob = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
                if names:
                    best = total.argmax(axis=1)
                    prob = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                cols = [batch.schema.names.index(c) for c in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column(j) for j in cols] + [pa.array(lang, pa.string()), pa.array(np.where(known, prob, 0.0))],
                    names=keys + ["lang_pred", "score"])

    return df.mapInArrow(score, out)
