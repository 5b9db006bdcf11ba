"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

Features of a text are the 64-bit hashes of its words and of their beginnings of ``PREFIXES`` letters, each
counted once. The model is P(grade <= k) = sigmoid(threshold_k - x.w): one weight vector shared by all
ordered thresholds. It is fitted on a bounded sample of labelled rows (``max_rows``) over a bounded set of
features (``max_features``: those in most texts of a grade above 0, without those in over a fifth of all that are as frequent in grade 0)
with an L1 penalty, so only features that tell grades apart keep a weight and long texts gather no noise.
Scoring reads every whole text; the weights are broadcast, at most ``max_features`` numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.words import Words, mix, repeats_by_text, text_batches
from auger.session import write_scratch

PREFIXES = (4, 5, 6)
MAX_ROWS, MAX_FEATURES, L1 = 10_000, 20_000, 4e-4
TOXIC_AT = 0.3


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, ascending, and their offsets."""
    w = Words(texts, prefixes=PREFIXES)
    parts = [w.hash] + [mix(w.prefix[p] + np.uint64(p)) for p in PREFIXES]
    return repeats_by_text(np.stack(parts, axis=1).ravel(), w.off * len(parts))


@dataclass
class Model:
    """``features`` (ascending hashes), their ``weights``, and the ordered ``thresholds`` between grades."""
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, eta: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last: one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))


def fit_ordinal(index: np.ndarray, off: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int,
                l1: float = L1, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean log loss plus ``l1`` times the sum of absolute weights,
    by accelerated proximal gradient steps scaled by the features' frequencies. Row i has the features
    ``index[off[i]:off[i + 1]]``, each with value 1."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(off))
    scale = np.maximum(np.bincount(index, minlength=n_features), 1) / n
    v = np.ones(n_features)  # largest eigenvalue of the scaled second moments, by power iteration
    for _ in range(20):
        v = np.bincount(index, weights=np.bincount(row, weights=(v / np.sqrt(scale))[index], minlength=n)[row],
                        minlength=n_features) / np.sqrt(scale) / n
        size = np.sqrt((v * v).sum()) or 1.0
        v = v / size
    step = 1 / (0.5 * max(size, 1.0) * scale)  # the loss bends by a half at most along x.w

    share = np.clip(np.array([(grade <= k).mean() for k in range(n_grades - 1)]), 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))  # first threshold, log gaps
    w = np.zeros(n_features)
    y_w, y_free, t = w, free, 1.0
    for _ in range(steps):
        theta = np.concatenate((y_free[:1], y_free[0] + np.cumsum(np.exp(y_free[1:]))))
        eta = np.bincount(row, weights=y_w[index], minlength=n)
        edge = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -40, 40)))
        edge = np.concatenate((np.zeros((n, 1)), edge, np.ones((n, 1))), axis=1)
        low, high = edge[np.arange(n), grade], edge[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p  # of the log likelihood, by the thresholds around it
        g_w = np.bincount(index, weights=(d_high - d_low)[row], minlength=n_features) / n
        g_theta = np.array([(d_low * (grade == k + 1)).sum() - (d_high * (grade == k)).sum() for k in range(n_grades - 1)]) / n
        g_free = np.concatenate(([g_theta.sum()], [g_theta[k:].sum() * np.exp(y_free[k]) for k in range(1, len(free))]))
        new = y_w - step * g_w
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_free = y_free - g_free
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y_w, y_free = new + (t - 1) / faster * (new - w), new_free + (t - 1) / faster * (new_free - free)
        w, free, t = new, new_free, faster
    return w, np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))


def fit(docs: DataFrame, grades: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, l1: float = L1) -> Model:
    """``docs``: doc_id, text; ``grades``: doc_id, grade (0, 1, ...; null: not labelled). The sample are the
    labelled rows with the smallest hashes of their id, about ``max_rows``. Without rows of two grades
    at least the model gives grade 0 to all."""
    labelled = grades.select("doc_id", F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    n = labelled.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = write_scratch(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")  # about max_rows
    names = ["feature", "n"]

    def graded(batches):
        for batch in batches:
            for b in text_batches(batch):
                values, _ = text_features(b.column("text").to_pylist())
                f, count = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(count)], names=names)

    common = (rows.where("grade > 0").select("text").mapInArrow(graded, "feature long, n long")
              .groupBy("feature").agg(F.sum("n").alias("n")).where("n > 2")
              .orderBy(F.desc("n"), "feature").limit(max_features).toArrow())
    features = np.sort(common.column("feature").to_numpy().view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast(features)

    def design(batches):
        for batch in batches:
            for b in text_batches(batch):
                index = _known(known.value, *text_features(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.list_(pa.int32())), b.column("grade")], names=["index", "grade"])

    table = rows.select("text", "grade").mapInArrow(design, "index array<int>, grade int").toArrow()  # max_rows bounded lists
    grade = table.column("grade").to_numpy()
    if len(np.unique(grade)) < 2:
        return Model(features[:0], np.zeros(0), np.full(1, 40.0))
    lists = table.column("index").combine_chunks()
    off = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    index = lists.flatten().to_numpy()
    usual = _usual(index, off, grade, len(features))
    drop = np.concatenate(([0], np.cumsum(usual[index])))
    off = off - drop[off]
    index = index[~usual[index]]
    w, thresholds = fit_ordinal(index, off, grade, len(features), int(grade.max()) + 1, l1)
    kept = w != 0
    return Model(features[kept], w[kept], thresholds)


def _usual(index: np.ndarray, off: np.ndarray, grade: np.ndarray, n_features: int) -> np.ndarray:
    """Features in over a fifth of the rows whose shares in grade 0 and above differ by three standard errors at most."""
    above = grade > 0
    n, n_above = len(grade), int(above.sum())
    if n_above in (0, n):
        return np.zeros(n_features, dtype=bool)
    count = np.bincount(index, minlength=n_features)
    toxic = np.bincount(index, weights=above[np.repeat(np.arange(n), np.diff(off))], minlength=n_features)
    share = count / n
    error = np.sqrt(share * (1 - share) * (1 / n_above + 1 / (n - n_above)))
    return (share > 0.2) & (np.abs(toxic / n_above - (count - toxic) / (n - n_above)) <= 3 * error)


def _known(features: np.ndarray, values: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    if not len(features):
        return [np.empty(0, dtype=np.int32)] * (len(off) - 1)
    at = np.minimum(np.searchsorted(features, values), len(features) - 1)
    hit = features[at] == values
    run = np.concatenate(([0], np.cumsum(hit)))
    flat = at[hit].astype(np.int32)
    return [flat[run[a]:run[b]] for a, b in zip(off[:-1], off[1:])]


def predict(docs: DataFrame, model: Model, text: str = "text", toxic_at: float = TOXIC_AT) -> DataFrame:
    """``docs`` with ``expected_severity`` (mean grade), ``grade`` (the likeliest; ties: the lower) and ``toxic``
    (a grade above 0 has at least the probability ``toxic_at``; below a half, since the penalty draws
    probabilities towards the base rates). Null and empty texts have no features and get the base rates;
    repeated rows stay; columns of these three names are replaced, others kept."""
    keys = [c for c in docs.columns if c not in ("expected_severity", "grade", "toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select([F.col(f"`{c}`") for c in keys]).schema.add("expected_severity", "double").add("grade", "integer").add("toxic", "boolean")

    def score(batches):
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            for b in text_batches(batch.rename_columns(["text" if c == text else "\0" + c for c in names])):
                eta = np.array([m.weights[i].sum() for i in _known(m.features, *text_features(b.column("text").to_pylist()))])
                edge = m.at_most(eta) if len(eta) else np.zeros((0, len(m.thresholds)))
                p = np.diff(np.concatenate((np.zeros((len(eta), 1)), edge, np.ones((len(eta), 1))), axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(names.index(c)) for c in keys]
                    + [pa.array(p @ np.arange(p.shape[1], dtype=float)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(edge[:, 0] <= 1 - toxic_at)],
                    names=[*keys, "expected_severity", "grade", "toxic"])

    return docs.mapInArrow(score, schema)
