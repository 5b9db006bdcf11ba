"""H7 (exact leaf re-fit) and H8: gradient boosting with Newton leaf values, as a Spark loop.

Per round: residual columns ``r_k = y_k - p_k``; one ``DecisionTreeRegressor`` (distributed
histogram tree) per fitted class k, the K fits submitted concurrently; one pass tags every row
with its leaf in each tree and ``groupBy(class, leaf)`` gives
``gamma = (K-1)/K * sum(r) / sum(|r|(1-|r|))`` (at most K x 2^depth rows reach the driver);
``F_k += rate * gamma[leaf]`` through a literal map.
The working table is checkpointed to the shared checkpoint folder every round, which bounds the
lineage and lets a lost executor resume from the last round.

Two classes use one tree per round on class 0 and ``p0 = 1 / (1 + exp(-2F))``, start value
``F = 1/2 ln(p0 / p1)``. K > 2 classes use K trees per round, softmax probabilities and a start
at the centred log priors.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auger.session import materialize

MAX_CLASSES = 1000
MAX_PARALLEL_TREES = 8
CHECKPOINT_EVERY = 5


@dataclass
class BoostRound:
    trees: list[DecisionTreeRegressionModel]
    gammas: list[dict[float, float]]


@dataclass
class MultiBoostModel:
    n_classes: int
    init: list[float]
    rate: float
    features: str
    rounds: list[BoostRound] = field(default_factory=list)
    history: list[float] = field(default_factory=list)  # training log-loss before each round (F8)

    def _scores(self, df: DataFrame, prefix: str = "_F") -> tuple[DataFrame, list[str]]:
        K = self.n_classes
        n_f = 1 if K == 2 else K
        cols = [f"{prefix}{k}" for k in range(n_f)]
        out = df.withColumns({c: F.lit(self.init[k]) for k, c in enumerate(cols)})
        for i, rnd in enumerate(self.rounds):
            for k, (tree, gam) in enumerate(zip(rnd.trees, rnd.gammas)):
                leaf = f"_leaf_{i}_{k}"
                t = tree.copy()
                t.setLeafCol(leaf).setPredictionCol(f"_tp_{i}_{k}").setFeaturesCol(self.features)
                out = t.transform(out)
                out = out.withColumn(cols[k], F.col(cols[k]) + F.lit(self.rate) * _lookup(gam, F.col(leaf)))
                out = out.drop(leaf, f"_tp_{i}_{k}")
        return out, cols

    @property
    def featureImportances(self):
        """gain importances summed over every tree of every round and class, normalised."""
        from pyspark.ml.linalg import Vectors
        tot = None
        for rnd in self.rounds:
            for t in rnd.trees:
                v = t.featureImportances.toArray()
                tot = v if tot is None else tot + v
        if tot is None:
            return Vectors.dense([])
        s = tot.sum()
        return Vectors.dense(tot / s if s > 0 else tot)

    def transform(self, df: DataFrame, prediction: str = "prediction", prob_prefix: str = "p") -> DataFrame:
        out, cols = self._scores(df)
        probs = probabilities(self.n_classes, [F.col(c) for c in cols])
        out = out.withColumns({f"{prob_prefix}{k}": p for k, p in enumerate(probs)})
        best = F.array_max(F.array(*[F.struct(F.col(f"{prob_prefix}{k}").alias("p"), F.lit(-k).alias("nk"))
                                     for k in range(self.n_classes)]))
        return out.withColumn(prediction, (-best["nk"]).cast("double")).drop(*cols)


def _lookup(gam: dict[float, float], leaf: Column) -> Column:
    if not gam:
        return F.lit(0.0)
    m = F.create_map(*[x for kv in sorted(gam.items()) for x in (F.lit(float(kv[0])), F.lit(float(kv[1])))])
    return F.coalesce(F.element_at(m, leaf), F.lit(0.0))


def probabilities(K: int, scores: list[Column]) -> list[Column]:
    if K == 2:
        p0 = 1.0 / (1.0 + F.exp(-2.0 * scores[0]))
        return [p0, 1.0 - p0]
    mx = F.greatest(*scores)
    ex = [F.exp(s - mx) for s in scores]
    tot = ex[0]
    for e in ex[1:]:
        tot = tot + e
    return [e / tot for e in ex]


def start_values(priors: list[float]) -> list[float]:
    if len(priors) == 2:
        return [0.5 * math.log(priors[0] / priors[1])]
    logs = [math.log(max(p, 1e-300)) for p in priors]
    mean = sum(logs) / len(logs)
    return [v - mean for v in logs]


def leaf_value(K: int, sum_r: float, sum_w: float) -> float:
    """Newton step for one leaf; a leaf with zero curvature gets 0."""
    return (K - 1) / K * sum_r / sum_w if sum_w else 0.0


def fit_boosting(df: DataFrame, features: str = "features", label: str = "label", n_classes: int | None = None,
                 rounds: int = 5, depth: int = 5, bins: int = 20, rate: float = 1.0, min_rows: int = 1,
                 seed: int = 42) -> MultiBoostModel:
    """Fit on ``df`` with class indexes 0..K-1 in ``label``."""
    base = df.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    counts = {r[0]: r[1] for r in base.groupBy("_y").count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError("too many classes")
    if not counts:
        raise ValueError("no training rows")
    K = n_classes or int(max(counts)) + 1
    K = max(K, 2)
    n = sum(counts.values())
    priors = [counts.get(float(k), 0) / n for k in range(K)]
    init = start_values([max(p, 1e-12) for p in priors])
    model = MultiBoostModel(K, init, rate, features)
    n_f = 1 if K == 2 else K
    cur = base.withColumns({f"_F{k}": F.lit(init[k]) for k in range(n_f)})
    cur = cur.transform(materialize).persist(StorageLevel.MEMORY_AND_DISK)
    for i in range(rounds):
        probs = probabilities(K, [F.col(f"_F{k}") for k in range(n_f)])
        work = cur.withColumns({f"_r{k}": F.when(F.col("_y") == k, 1.0).otherwise(0.0) - probs[k]
                                for k in range(n_f)}).persist(StorageLevel.MEMORY_AND_DISK)
        # the K trees of one round are independent given the round's residuals: fit them as
        # concurrent Spark jobs (the scheduler interleaves their tasks)
        def fit_one(k: int):
            return DecisionTreeRegressor(featuresCol="_x", labelCol=f"_r{k}", maxDepth=depth, maxBins=bins,
                                         minInstancesPerNode=min_rows, seed=seed + 31 * i + k,
                                         predictionCol=f"_tp{k}", leafCol=f"_leaf{k}").fit(work)

        with ThreadPoolExecutor(max_workers=min(n_f, MAX_PARALLEL_TREES)) as pool:
            trees = list(pool.map(fit_one, range(n_f)))
        # one pass tags every row with its leaf in each of the K trees and sums the residuals per
        # (class, leaf): at most K x 2^depth rows reach the driver
        tagged = work
        for t in trees:
            tagged = t.transform(tagged)
        tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
        # the training log-loss before this round rides along on class 0's rows (no extra pass)
        p_true = F.element_at(F.array(*probs), F.col("_y").cast("int") + 1)
        nll = -F.log(F.greatest(p_true, F.lit(1e-15)))
        per_leaf = tagged.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), F.col(f"_leaf{k}").alias("leaf"), F.col(f"_r{k}").alias("r"),
                     (nll if k == 0 else F.lit(0.0)).alias("nll"))
            for k in range(n_f)])).alias("t")).select("t.*")
        stats = (per_leaf.groupBy("k", "leaf")
                 .agg(F.sum("r").alias("sr"), F.sum(F.abs(F.col("r")) * (1 - F.abs(F.col("r")))).alias("sw"),
                      F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("n"))
                 .collect())
        model.history.append(sum(r["nll"] for r in stats) / max(1, sum(r["n"] for r in stats if r["k"] == 0)))
        work.unpersist()  # the tagged copy is cached now
        gammas: list[dict[float, float]] = [{} for _ in range(n_f)]
        for r in stats:
            gammas[r["k"]][float(r["leaf"])] = leaf_value(K, r["sr"], r["sw"])
        nxt = tagged.withColumns({f"_F{k}": F.col(f"_F{k}") + F.lit(rate) * _lookup(gammas[k], F.col(f"_leaf{k}"))
                                  for k in range(n_f)})
        nxt = nxt.drop(*[f"_leaf{k}" for k in range(n_f)], *[f"_tp{k}" for k in range(n_f)])
        model.rounds.append(BoostRound(trees, gammas))
        new = nxt.drop(*[f"_r{k}" for k in range(n_f)])
        if (i + 1) % CHECKPOINT_EVERY == 0 and i + 1 < rounds:  # a lost executor costs a few rounds at most
            new = new.transform(materialize)
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        if i + 1 < rounds:
            new.count()  # before the tables it is made from go
        tagged.unpersist()
        cur.unpersist()
        cur = new
    cur.unpersist()
    return model
