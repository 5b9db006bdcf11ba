"""H7, H8, F8: gradient boosting on histograms, with level-set splits and the loss of a validation part.

Features become small integers once: numbers by equal-width ranges between the training rows' least and
greatest value, text levels by their place in a dictionary table, however many there are; a missing
value is -1. The table of bins, classes and scores is written, and rewritten every ``REWRITE`` rounds.

A round grows the trees of all classes together, one scan a level: a task brings its rows' scores up to
date with the rounds since the last rewrite, walks them down the trees so far and adds up
(tree, node, feature, bin) -> rows, residuals, weights. Spark sums these, orders the bins of each node and
feature (numbers by value, levels by their mean residual), and takes the best cut by running sums. Only the
cuts are on the driver. Sums of both sides of a cut are the leaf values' sums, so there is no pass for those.
Rows of the validation part carry scores along but are not summed; each round's first scan gives the mean
loss of both parts.

Two classes use one tree a round, more classes one each; leaf values are Newton steps as in ``boosting``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auger.functions.encoding import LevelDictionary
from auger.operators.learners.boosting import leaf_value, start_values
from auger.session import drop_scratch, write_scratch

REWRITE = 5
DENSE = 4_000_000  # cells of a task's histogram that are kept as plain arrays
LOSS_TRAIN, LOSS_VALID, ROOT = -1, -2, -3  # in place of a feature


@dataclass
class Split:
    """Rows whose bin is at most ``cut`` (numbers) or in ``left`` (sorted levels) go left."""

    feature: int
    cut: int
    left: np.ndarray | None
    gain: float


@dataclass
class Tree:
    """Nodes by heap number (children of i: 2i + 1, 2i + 2); a node without a split is a leaf."""

    splits: dict[int, Split] = field(default_factory=dict)
    stats: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # rows, residuals, weights
    values: dict[int, float] = field(default_factory=dict)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        for i in sorted(self.splits):
            at = np.flatnonzero(node == i)
            s = self.splits[i]
            b = bins[at, s.feature]
            left = b <= s.cut if s.left is None else np.isin(b, s.left)
            node[at] = np.where(left, 2 * i + 1, 2 * i + 2)
        return node

    def add_to(self, scores: np.ndarray, bins: np.ndarray, rate: float) -> None:
        node = self.walk(bins)
        for i, v in self.values.items():
            scores[node == i] += rate * v


@dataclass
class Binning:
    """Numeric columns with (least value, width of a bin), then categorical ones with their dictionary."""

    numeric: list[tuple[str, float, float]]
    categorical: list[str]
    levels: LevelDictionary | None
    n_bins: int

    @property
    def names(self) -> list[str]:
        return [c for c, _, _ in self.numeric] + self.categorical

    def cells(self) -> np.ndarray:
        """Bins of each feature, the missing one included."""
        sizes = self.levels.sizes() if self.levels else {}
        return np.array([self.n_bins + 1] * len(self.numeric) + [sizes[c] + 1 for c in self.categorical], dtype=np.int64)

    def transform(self, df: DataFrame, out: str = "_bins") -> DataFrame:
        def number(c: str, low: float, width: float) -> Column:
            x = F.col(f"`{c}`").cast("double")
            place = F.floor((x - low) / width) if width > 0 else F.lit(0)
            inside = F.least(F.greatest(place, F.lit(0)), F.lit(self.n_bins - 1))
            return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(inside).cast("int")

        names = [f"_level_{i}" for i in range(len(self.categorical))]
        if self.levels:
            df = self.levels.transform(df, dict(zip(self.categorical, names)))
        levels = [F.coalesce(F.col(n), F.lit(-1)).cast("int") for n in names]
        return df.withColumn(out, F.array(*[number(*x) for x in self.numeric], *levels)).drop(*names)


def fit_binning(df: DataFrame, numeric: list[str], categorical: list[str], n_bins: int = 20) -> Binning:
    ranges = []
    if numeric:
        x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in numeric}
        r = df.agg(*[f(x[c]).alias(f"{i}{k}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(numeric):
            lo, hi = (v if v is not None and np.isfinite(v) else 0.0 for v in (r[f"{i}lo"], r[f"{i}hi"]))
            ranges.append((c, lo, (hi - lo) / n_bins))
    return Binning(ranges, list(categorical), LevelDictionary.fit(df, categorical) if categorical else None, n_bins)


def class_probabilities(scores: np.ndarray) -> np.ndarray:
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-2 * scores))
        return np.hstack([p, 1 - p])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class HistogramBoostModel:
    binning: Binning
    n_classes: int
    start: list[float]
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[tuple[int, float | None, float | None]] = field(default_factory=list)  # round, training, validation

    def history(self, spark) -> DataFrame:
        """F8: ``iteration, train_loss, valid_loss``, the mean log-loss after each round (0: before the first)."""
        return spark.createDataFrame(self.losses, "iteration int, train_loss double, valid_loss double")

    def best_round(self) -> int:
        """The round of the least validation loss (of the training loss where there is no validation part)."""
        key = 2 if any(x[2] is not None for x in self.losses) else 1
        return min(self.losses, key=lambda x: (x[key] if x[key] is not None else np.inf, x[0]))[0]

    def keep(self, rounds: int) -> "HistogramBoostModel":
        return HistogramBoostModel(self.binning, self.n_classes, self.start, self.rate, self.rounds[:rounds], self.losses[:rounds + 1])

    def transform(self, df: DataFrame, prediction: str = "prediction", prob_prefix: str = "p") -> DataFrame:
        start, rate, rounds = np.array(self.start), self.rate, self.rounds

        @F.pandas_udf("array<double>")
        def probabilities(bins: pd.Series) -> pd.Series:
            b = np.stack(bins.to_numpy()) if len(bins) else np.empty((0, 0), dtype=np.int64)
            scores = np.tile(start, (len(b), 1))
            for trees in rounds:
                for k, t in enumerate(trees):
                    t.add_to(scores[:, k], b, rate)
            return pd.Series(list(class_probabilities(scores)))

        out = self.binning.transform(df).withColumn("_p", probabilities("_bins"))
        out = out.withColumns({f"{prob_prefix}{k}": F.col("_p")[k] for k in range(self.n_classes)})
        # the class of the greatest probability, the first of equal ones
        return out.withColumn(prediction, (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_bins", "_p")

    def splits(self, spark) -> DataFrame:
        """One row per node: ``round, tree, node, feature`` (null in a leaf)``, cut`` (of a number), ``n_levels`` (that
        go left), ``gain, n, value`` (of a leaf)."""
        names = self.binning.names
        rows = []
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                for i, (n, _, _) in sorted(t.stats.items()):
                    s = t.splits.get(i)
                    rows.append((r, k, i, names[s.feature] if s else None, None if not s or s.left is not None else s.cut,
                                 len(s.left) if s and s.left is not None else None, s.gain if s else None, int(n), t.values.get(i)))
        return spark.createDataFrame(rows, "round int, tree int, node int, feature string, cut int, n_levels int, gain double, n long, value double")


def _sums(table: DataFrame, rate: float, recent: list[list[Tree]], trees: list[Tree], level: int, cells: np.ndarray) -> DataFrame:
    """One scan: ``tree, node, feature, bin, n, s, w`` of the nodes of a level, and the losses at level 0."""
    first, offset = 2 ** level - 1, np.concatenate(([0], np.cumsum(cells)))
    width, nodes = int(offset[-1]), 2 ** level
    dense = len(trees) * nodes * width <= DENSE

    def run(batches):
        keys, sums = np.empty(0, dtype=np.int64), np.zeros((3, len(trees) * nodes * width if dense else 0))
        other = np.zeros((2 + len(trees), 3))
        for batch in batches:
            bins = batch.column("_bins").flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
            scores = batch.column("_F").flatten().to_numpy().reshape(len(batch), -1).copy()
            y, valid = batch.column("_y").to_numpy(), batch.column("_valid").to_numpy(zero_copy_only=False)
            for done in recent:
                for k, t in enumerate(done):
                    t.add_to(scores[:, k], bins, rate)
            p = class_probabilities(scores)
            use = ~valid
            if level == 0:
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
                other[0] += use.sum(), loss[use].sum(), 0
                other[1] += valid.sum(), loss[valid].sum(), 0
            found, parts = [], []
            for k, t in enumerate(trees):
                r = (y[use] == k) - p[use, k]
                w = np.abs(r) * (1 - np.abs(r))
                if level == 0:
                    other[2 + k] += len(r), r.sum(), w.sum()
                node = t.walk(bins[use]) - first
                at = np.flatnonzero(node >= 0)  # the others rest in leaves above
                key = ((k * nodes + node[at])[:, None] * width + offset[:-1] + bins[use][at] + 1).ravel()
                repeat = np.broadcast_to(np.stack((np.ones(len(at)), r[at], w[at]))[:, :, None], (3, len(at), len(cells))).reshape(3, -1)
                if dense:
                    for v in range(3):
                        sums[v] += np.bincount(key, weights=repeat[v], minlength=sums.shape[1])
                else:
                    found.append(key)
                    parts.append(repeat)
            if not dense:
                keys, at = np.unique(np.concatenate([keys, *found]), return_inverse=True)
                sums = np.stack([np.bincount(at, weights=v, minlength=len(keys)) for v in np.concatenate([sums, *parts], axis=1)])
        if dense:
            keys = np.flatnonzero(sums[0])
            sums = sums[:, keys]
        k, rest = np.divmod(keys, nodes * width)
        node, cell = np.divmod(rest, width)
        feature = np.searchsorted(offset, cell, side="right") - 1
        rows = {"tree": k, "node": node + first, "feature": feature, "bin": cell - offset[feature] - 1}
        extra = [(-1, LOSS_TRAIN), (-1, LOSS_VALID), *((k, ROOT) for k in range(len(trees)))] if level == 0 else []
        for i, (k, f) in enumerate(extra):
            rows = {c: np.append(v, x) for (c, v), x in zip(rows.items(), (k, 0, f, 0))}
            sums = np.concatenate((sums, other[i][:, None]), axis=1)
        yield pa.RecordBatch.from_pydict({c: v.astype(np.int32) for c, v in rows.items()} | dict(zip(("n", "s", "w"), sums)))

    schema = "tree int, node int, feature int, bin int, n double, s double, w double"
    parts = table.select("_bins", "_F", "_y", "_valid").mapInArrow(run, schema)
    return parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "w")])


def best_splits(sums: DataFrame, n_numeric: int, min_rows: int = 1) -> DataFrame:
    """The best cut of each node: ``tree, node, feature, gain, cut``, the bins that go left (``left``: of levels, else
    null), and the rows, residuals and weights of the left side. Equal gains: the first feature, then cut."""
    numeric = F.col("feature") < n_numeric
    each = Window.partitionBy("tree", "node", "feature")
    order = each.orderBy(F.when(numeric, F.col("bin")).otherwise(F.round(F.col("s") / F.col("n"), 9)), "bin")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.where("feature >= 0").withColumns(
        {"pos": F.row_number().over(order), **{f"l{c}": F.sum(c).over(running) for c in "nsw"},
         "tn": F.sum("n").over(each), "ts": F.sum("s").over(each)})
    right = F.col("tn") - F.col("ln")
    gain = (F.col("ls") ** 2 / F.col("ln") + (F.col("ts") - F.col("ls")) ** 2 / right - F.col("ts") ** 2 / F.col("tn"))
    cuts = cum.where((F.col("ln") >= min_rows) & (right >= min_rows)).withColumn("gain", F.round(gain, 6)).where("gain > 0")
    best = cuts.groupBy("tree", "node").agg(F.max_by(
        F.struct("feature", "pos", "gain", "ln", "ls", "lw"), F.struct("gain", -F.col("feature"), -F.col("pos"))).alias("b"))
    best = best.select("tree", "node", "b.feature", F.col("b.pos").alias("_pos"), "b.gain", "b.ln", "b.ls", "b.lw")
    # one row per node of the level: at most 2^level per class
    return (cum.select("tree", "node", "feature", "bin", "pos").join(F.broadcast(best), ["tree", "node", "feature"])
            .where("pos <= _pos").groupBy("tree", "node", "feature", "gain", "ln", "ls", "lw")
            .agg(F.max("bin").alias("cut"), F.collect_list(F.when(~numeric, F.col("bin"))).alias("left")))


def _grow(table: DataFrame, model: HistogramBoostModel, recent, n_trees: int, depth: int, min_rows: int, cells) -> tuple[list[Tree], list]:
    trees = [Tree() for _ in range(n_trees)]
    n_numeric = len(model.binning.numeric)
    losses = []
    for level in range(max(depth, 1)):
        sums = _sums(table, model.rate, recent, trees, level, cells).persist(StorageLevel.MEMORY_AND_DISK)
        if level == 0:
            for r in sums.where("feature < 0").collect():
                if r["feature"] == ROOT:
                    trees[r["tree"]].stats[0] = (r["n"], r["s"], r["w"])
                else:
                    losses.append((r["feature"], r["s"] / r["n"] if r["n"] else None))
        found = best_splits(sums, n_numeric, min_rows).collect() if depth else []  # depth 0: the losses alone
        sums.unpersist()
        for r in found:
            t, i = trees[r["tree"]], r["node"]
            left = (r["ln"], r["ls"], r["lw"])
            levels = None if r["feature"] < n_numeric else np.array(sorted(r["left"]), dtype=np.int64)
            t.splits[i] = Split(r["feature"], r["cut"], levels, r["gain"])
            t.stats[2 * i + 1] = left
            t.stats[2 * i + 2] = tuple(a - b for a, b in zip(t.stats[i], left))
        if not found:
            break
    for t in trees:
        t.values = {i: leaf_value(model.n_classes, s, w) for i, (_, s, w) in t.stats.items() if i not in t.splits}
    return trees, losses


def fit_histogram_boosting(df: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "label",
                           valid: str | None = None, rounds: int = 5, depth: int = 5, bins: int = 20, rate: float = 0.1,
                           min_rows: int = 1, n_classes: int | None = None) -> HistogramBoostModel:
    """Fit on class indexes 0..K-1 in ``label``. Rows whose ``valid`` is true are the validation part."""
    held = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    train = df.where(~held)
    binning = fit_binning(train, numeric, list(categorical), bins)
    counts = train.agg(F.max(label).alias("k"), F.count(label).alias("n")).first()
    if not counts["n"]:
        raise ValueError("no training rows")
    K = max(2, n_classes or int(counts["k"]) + 1)
    per_class = {int(r[0]): r[1] for r in train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    start = start_values([max(per_class.get(k, 0) / counts["n"], 1e-12) for k in range(K)])
    model = HistogramBoostModel(binning, K, start, rate)
    cells = binning.cells()
    scores = F.array(*[F.lit(float(v)) for v in start])
    rows = binning.transform(df.where(F.col(label).isNotNull()).withColumn("_valid", held)).select(
        "_bins", F.col(label).cast("int").alias("_y"), "_valid", scores.alias("_F"))
    table, recent = write_scratch(rows, "boost-bins"), []
    for i in range(rounds + 1):
        last = i == rounds
        trees, losses = _grow(table, model, recent, len(start), 0 if last else depth, min_rows, cells)
        mean = dict(losses)
        model.losses.append((i, mean.get(LOSS_TRAIN), mean.get(LOSS_VALID)))
        if last:
            break
        model.rounds.append(trees)
        recent.append(trees)
        if len(recent) == REWRITE and i + 1 < rounds:
            new = write_scratch(_rescored(table, model, recent), "boost-bins")
            drop_scratch(table)
            table, recent = new, []
    drop_scratch(table)
    return model


def _rescored(table: DataFrame, model: HistogramBoostModel, recent: list[list[Tree]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            bins = batch.column("_bins").flatten().to_numpy().reshape(len(batch), -1)
            scores = batch.column("_F").flatten().to_numpy().reshape(len(batch), -1).copy()
            for done in recent:
                for k, t in enumerate(done):
                    t.add_to(scores[:, k], bins, model.rate)
            yield batch.set_column(batch.schema.get_field_index("_F"), "_F", pa.array(list(scores), pa.list_(pa.float64())))

    return table.mapInArrow(run, table.schema)
