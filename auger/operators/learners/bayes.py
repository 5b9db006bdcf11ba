"""H2: multinomial naive Bayes as one grouped aggregate.

Fitting is ``groupBy(label).agg(count, sum(x_j)...)``: a partial + final aggregate whose
output has one row per class. That table (classes x features) is the model. A small one becomes
literals in the scoring expression, so scoring is a pure projection with no join; one of many
classes stays a table and is applied block by block. Same estimates as ``pyspark.ml.classification.NaiveBayes``:
``log_prior = ln((n_c + s) / (n + C s))``, ``log_theta = ln((S_cj + s) / (S_c + d s))``.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auger.session import write_scratch

LITERAL_CELLS = 256  # up to this size a model is written into the plan itself
BLOCK_CELLS = 2_000_000  # numbers of a larger model that are broadcast together
MERGE_BLOCKS = 8
LEAF_CELLS = 1 << 16  # scores of a box of rows that are worked out together
MIN_BOX_ROWS = 16  # smaller boxes are not cut on
BOX_DEPTH = 14  # cuts of the box of all rows
BOX_LOOKS, ROW_LOOKS = 512, 64  # how often a class is looked at, at most, in the box of all rows and in a batch's boxes


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass
class NaiveBayesAggModel:
    labels: list
    log_prior: list[float]
    log_theta: list[list[float]]
    features: list[str]

    def class_scores(self, exprs: list[Column] | None = None) -> list[Column]:
        xs = exprs or [F.col(f).cast("double") for f in self.features]
        out = []
        for c in range(len(self.labels)):
            s = F.lit(self.log_prior[c])
            for j, x in enumerate(xs):
                s = s + x * F.lit(self.log_theta[c][j])
            out.append(s)
        return out

    def transform(self, df: DataFrame, out: str = "prediction", index_col: str | None = None) -> DataFrame:
        """Argmax class (first on ties). ``index_col`` also emits the class index."""
        scored = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("ni")) for i, s in enumerate(self.class_scores())])
        idx = -F.array_max(scored)["ni"]
        res = df.withColumn(out, F.element_at(F.array(*[F.lit(v) for v in self.labels]), idx + 1))
        if index_col:
            res = res.withColumn(index_col, idx.cast("double"))
        return res

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(str(self.labels[c]), f, float(self.log_prior[c]), float(self.log_theta[c][j]))
                for c in range(len(self.labels)) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "label string, feature string, log_prior double, log_theta double")


@dataclass
class NaiveBayesTableModel:
    """A model of any number of classes: ``table`` (``label, prior, theta``) is written, never collected whole.

    Scoring goes by blocks of at most ``BLOCK_CELLS`` numbers. Of a block, the classes that may be best somewhere
    between the rows' smallest and largest features (:func:`_leaders`) are broadcast; per Arrow batch, boxes of near
    rows try those that may be best there (:func:`_best_classes`). Each row carries its best class so far and keeps
    the better one. Every ``MERGE_BLOCKS`` blocks the rows are written, so a task holds few blocks at a time."""

    table: DataFrame
    features: list[str]

    def blocks(self):
        """(labels, priors, thetas) in the order of the labels."""
        rows, cells = [], max(1, BLOCK_CELLS // (len(self.features) + 1))
        for r in self.table.orderBy("label").toLocalIterator(prefetchPartitions=True):
            rows.append(r)
            if len(rows) == cells:
                yield self._block(rows)
                rows = []
        if rows:
            yield self._block(rows)

    @staticmethod
    def _block(rows):
        return [r["label"] for r in rows], np.array([r["prior"] for r in rows]), np.array([r["theta"] for r in rows])

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Argmax class; of equal ones the first label."""
        kind = self.table.schema["label"].dataType.simpleString()
        best = df.withColumns({"_x": F.array(*[F.col(f).cast("double") for f in self.features]),
                               "_best": F.lit(None).cast(f"struct<s: double, label: {kind}>")})
        xs = [F.col(f).cast("double") for f in self.features]
        ends = df.agg(*[F.min(x) for x in xs], *[F.max(F.when(~F.isnan(x), x)) for x in xs]).first()  # NaN is Spark's largest
        ends = np.array([np.nan if v is None else v for v in ends]).reshape(2, -1)
        for n, block in enumerate(self.blocks()):
            used = _leaders(*block[1:], *ends)
            block = [block[0][i] for i in used], block[1][used], block[2][used]
            if n and n % MERGE_BLOCKS == 0:
                best = write_scratch(best, "bayes-best")
            best = best.withColumn("_new", _best_of(df.sparkSession.sparkContext.broadcast(block), kind)("_x"))
            better = F.col("_best").isNull() | (F.col("_new.s") > F.col("_best.s"))  # of equal ones the earlier block's
            best = best.withColumn("_best", F.when(better, F.col("_new")).otherwise(F.col("_best"))).drop("_new")
        return best.withColumn(out, F.col("_best.label")).drop("_x", "_best")


def _plain_best(x: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every class on every row."""
    s, at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
    step = max(1, 2_000_000 // len(prior))
    for lo in range(0, len(x), step):
        scores = x[lo:lo + step] @ theta.T + prior
        at[lo:lo + step] = np.nan_to_num(scores, nan=-np.inf).argmax(axis=1)
        s[lo:lo + step] = scores[np.arange(len(scores)), at[lo:lo + step]]
    return s, at


def _few_best(x: np.ndarray, p: np.ndarray, t: np.ndarray, near_by: float) -> tuple[np.ndarray, np.ndarray]:
    """The best of a few classes (``p``, and ``t`` by feature and class), of equal ones the first; scores are added up
    feature by feature, so a class has the same score in whatever company."""
    s, at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
    step = max(1, LEAF_CELLS // len(p))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        scores = part @ t + p
        r, c = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - near_by)
        exact = p[c]
        for j in range(len(t)):
            exact = exact + part[r, j] * t[j, c]
        order = np.lexsort((c, -exact, r))
        first = order[np.searchsorted(r, np.arange(len(part)))]  # r ascends, so the order keeps each row's place
        s[lo:lo + step], at[lo:lo + step] = exact[first], c[first]
    return s, at


def _rounding(p: np.ndarray, t: np.ndarray, most: np.ndarray) -> float:
    """Above what two ways to add up a score can differ by; ``most``: the largest absolute value of each feature."""
    return 8 * (len(t) + 4) * np.finfo(float).eps * (np.abs(p).max() + np.abs(t).max(axis=1) @ most)


def _may_lead(p: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, near_by: float) -> np.ndarray:
    """The classes that may be best somewhere in the box: a class's lead over the one that is best in the middle is
    at most the sum over the features of its larger lead at the two ends."""
    lead = (p + ((lo + hi) / 2) @ t).argmax()
    bound = p - p[lead]
    for j in range(len(t)):
        gap = t[j] - t[j, lead]
        bound += np.maximum(gap * lo[j], gap * hi[j])
    return np.flatnonzero(bound >= -near_by)


def _leaders(prior: np.ndarray, theta: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The classes that may be best somewhere in the box of all rows, found by halving it, of equal ones the first; the
    first class stays too, which a row with a null gets."""
    if not (np.isfinite(prior).all() and np.isfinite(theta).all() and np.isfinite(lo).all() and np.isfinite(hi).all()):
        return np.arange(len(prior))
    t = np.ascontiguousarray(theta.T)
    near_by = _rounding(prior, t, np.maximum(np.abs(lo), np.abs(hi)))
    used = np.zeros(len(prior), dtype=bool)
    used[0] = True
    todo, looks = deque([(lo, hi, np.arange(len(prior)), 0)]), BOX_LOOKS * len(prior)
    while todo:
        lo, hi, cls, depth = todo.popleft()
        looks -= len(cls)
        if looks < 0 or used[cls].all():
            used[cls] = True
            continue
        p, tc = prior[cls], t[:, cls]
        kept = cls[_may_lead(p, tc, lo, hi, near_by)]
        if depth == BOX_DEPTH:
            used[kept] = True
            continue
        axis = ((hi - lo) * (tc.max(axis=1) - tc.min(axis=1))).argmax()
        mid = lo.copy(), hi.copy()
        mid[0][axis] = mid[1][axis] = (lo[axis] + hi[axis]) / 2
        todo += [(lo, mid[1], kept, depth + 1), (mid[0], hi, kept, depth + 1)]
    used = np.flatnonzero(used)
    return np.sort(used[np.unique(np.column_stack([prior, theta])[used], axis=0, return_index=True)[1]])


def _best_classes(x: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of the best class of each row, without trying every class on every row.

    Rows are halved into boxes, and a box tries those classes that may lead in it."""
    s, at = np.full(len(x), np.nan), np.zeros(len(x), dtype=np.int64)  # a NaN makes all scores NaN: the first class
    finite = np.isfinite(x).all(axis=1)
    cls = np.flatnonzero(~np.isnan(prior) & ~np.isnan(theta).any(axis=1))
    p, t = prior[cls], np.ascontiguousarray(theta[cls].T)
    if not len(cls) or np.isinf(p).any() or np.isinf(t).any():
        return _plain_best(x, prior, theta)
    odd = np.flatnonzero(~finite & ~np.isnan(x).any(axis=1))
    if len(odd):
        s[odd], at[odd] = _plain_best(x[odd], prior, theta)
    if not finite.any():
        return s, at
    near_by = _rounding(p, t, np.abs(x[finite]).max(axis=0))
    todo, looks = deque([(np.flatnonzero(finite), np.arange(len(cls)))]), ROW_LOOKS * len(cls)
    while todo:
        rows, kept = todo.popleft()
        part, looks = x[rows], looks - len(kept)
        if len(rows) > MIN_BOX_ROWS and len(rows) * len(kept) > LEAF_CELLS and looks > 0:
            lo, hi = part.min(axis=0), part.max(axis=0)
            kept = kept[_may_lead(p[kept], t[:, kept], lo, hi, near_by)]
            if len(rows) * len(kept) > LEAF_CELLS:
                axis = ((hi - lo) * (t[:, kept].max(axis=1) - t[:, kept].min(axis=1))).argmax()
                half = np.argpartition(part[:, axis], len(rows) // 2)
                todo += [(rows[half[:len(rows) // 2]], kept), (rows[half[len(rows) // 2:]], kept)]
                continue
        s[rows], best = _few_best(part, p[kept], t[:, kept], near_by)
        at[rows] = cls[kept[best]]
    return s, at


def _best_of(block, kind: str):
    @F.pandas_udf(f"struct<s: double, label: {kind}>")
    def best(xs: pd.Series) -> pd.DataFrame:
        labels, prior, theta = block.value
        x = np.array(xs.tolist(), dtype=np.float64).reshape(len(xs), theta.shape[1])  # nulls become NaN
        s, at = _best_classes(x, prior, theta)
        return pd.DataFrame({"s": s, "label": [labels[i] for i in at]})

    return best


def naive_bayes_fit(df: DataFrame, features: list[str], label: str, smoothing: float = 1.0) -> NaiveBayesAggModel | NaiveBayesTableModel:
    """Fit from non-negative feature columns; one aggregation, a row per class. Up to ``LITERAL_CELLS`` numbers
    become expressions; a larger model stays a table."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(_c(f).cast("double")).alias(f"_s{j}") for j, f in enumerate(features)]
    aggs.append(F.min(F.least(*[_c(f).cast("double") for f in features])).alias("_min"))
    k, d, s = 0, len(features), smoothing
    per_class = df.groupBy(F.col(label).alias("_label")).agg(*aggs)
    most = LITERAL_CELLS // max(1, d)
    stats = per_class.limit(most + 1).collect()
    if len(stats) > most:
        return _table_model(write_scratch(per_class, "bayes-classes"), features, s)
    if any(r["_min"] is not None and r["_min"] < 0 for r in stats):
        raise ValueError("multinomial naive Bayes needs non-negative features")
    stats.sort(key=lambda r: (r["_label"] is not None, r["_label"]))  # nulls first, as Spark orders
    n, k = sum(r["_n"] for r in stats), len(stats)
    if n == 0:
        raise ValueError("no training rows")
    labels = [r["_label"] for r in stats]
    prior = [math.log(r["_n"] + s) - math.log(n + k * s) for r in stats]
    theta = []
    for r in stats:
        sums = [r[f"_s{j}"] or 0.0 for j in range(d)]
        tot = math.log(sum(sums) + d * s)
        theta.append([math.log(v + s) - tot for v in sums])
    return NaiveBayesAggModel(labels, prior, theta, list(features))


def _table_model(per_class: DataFrame, features: list[str], s: float) -> NaiveBayesTableModel:
    whole = per_class.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("_min").alias("least")).first()
    if whole["least"] is not None and whole["least"] < 0:
        raise ValueError("multinomial naive Bayes needs non-negative features")
    sums = [F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) for j in range(len(features))]
    total = F.log(sum(sums[1:], sums[0]) + len(features) * s)
    table = per_class.select(F.col("_label").alias("label"), (F.log(F.col("_n") + s) - math.log(whole["n"] + whole["k"] * s)).alias("prior"),
                             F.array(*[F.log(v + s) - total for v in sums]).alias("theta"))
    return NaiveBayesTableModel(write_scratch(table, "bayes-model"), list(features))
