"""H3, H4: linear models by full-batch gradient descent, one Spark aggregate per iteration.

Semantics of the classic MLlib ``*WithSGD`` trainers: zero start, no intercept, step
``step / sqrt(i)`` in iteration ``i``, gradient averaged over the rows; logistic loss with no
regulariser, hinge loss with an L2 term ``w <- w (1 - step_i reg) - step_i g``. Each iteration
sends d weights to the tasks as literals and brings d sums back (``sum(mult * x_j)``), which is
the whole data movement: the rows never leave their partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auger.operators.splits import persisted


def _margin(ws: list[float], xs: list[Column]) -> Column:
    m = F.lit(0.0)
    for w, x in zip(ws, xs):
        if w != 0.0:
            m = m + x * F.lit(w)
    return m


@dataclass
class LinearSgdModel:
    weights: list[float]
    loss: str
    history: list[list[float]] = field(default_factory=list)
    threshold: float | None = None

    def margin(self, xs: list[Column]) -> Column:
        return _margin(self.weights, xs)

    def transform(self, df: DataFrame, xs: list[Column], out: str = "prediction", score_col: str = "p1") -> DataFrame:
        m = self.margin(xs)
        if self.loss == "logistic":
            s = 1.0 / (1.0 + F.exp(-m))
            thr = 0.5 if self.threshold is None else self.threshold
        else:
            s = m
            thr = 0.0 if self.threshold is None else self.threshold
        return df.withColumn(score_col, s).withColumn(out, F.when(F.col(score_col) > thr, 1.0).otherwise(0.0))

    def history_frame(self, spark: SparkSession) -> DataFrame:
        d = len(self.weights)
        schema = T.StructType([T.StructField("iteration", T.IntegerType())] +
                              [T.StructField(f"w{j}", T.DoubleType()) for j in range(d)])
        return spark.createDataFrame([(i + 1, *w) for i, w in enumerate(self.history)], schema)


def vector_features(col: str, d: int) -> list[Column]:
    """Element expressions of a vector column (dense or sparse), for :func:`sgd_linear`."""
    arr = vector_to_array(F.col(col))
    return [arr[j] for j in range(d)]


def sgd_linear(df: DataFrame, xs: list[Column], label: str | Column, loss: str = "logistic",
               iterations: int = 5, step: float = 1.0, reg: float = 0.0) -> LinearSgdModel:
    """Train on ``df``; ``xs`` are the feature expressions (d of them), ``label`` is 0/1."""
    if loss not in ("logistic", "hinge"):
        raise ValueError(loss)
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    d = len(xs)
    base = df.select(y.alias("_y"), *[x.cast("double").alias(f"_x{j}") for j, x in enumerate(xs)])
    cols = [F.col(f"_x{j}") for j in range(d)]
    w = [0.0] * d
    hist: list[list[float]] = []
    with persisted(base):
        for i in range(1, iterations + 1):
            m = _margin(w, cols)
            if loss == "logistic":
                mult = 1.0 / (1.0 + F.exp(-m)) - F.col("_y")
            else:
                ys = 2.0 * F.col("_y") - 1.0
                mult = F.when(F.lit(1.0) > ys * m, -ys).otherwise(0.0)
            row = base.agg(F.count(F.lit(1)).alias("_n"),
                           *[F.sum(mult * c).alias(f"_g{j}") for j, c in enumerate(cols)]).first()
            n = row["_n"]
            if not n:
                break
            st = step / math.sqrt(i)
            g = [row[f"_g{j}"] / n for j in range(d)]
            shrink = 1.0 - st * reg if loss == "hinge" else 1.0
            w = [wj * shrink - st * gj for wj, gj in zip(w, g)]
            hist.append(list(w))
    return LinearSgdModel(w, loss, hist)


def sgd_linear_vector(df: DataFrame, features: str, label: str | Column, loss: str = "logistic",
                      iterations: int = 5, step: float = 1.0, reg: float = 0.0) -> LinearSgdModel:
    """As :func:`sgd_linear` for a vector column (dense or sparse, e.g. hashed terms).

    The gradient sum is the difference of two weighted vector sums (``Summarizer.sum`` with
    ``1 + max(m, 0)`` and ``1 + max(-m, 0)`` as weights; the common ``sum(x)`` cancels, and no
    weight is ever zero): one JVM aggregate that walks sparse vectors by their non-zeros,
    whatever the width.
    """
    from pyspark.ml.stat import Summarizer

    if loss not in ("logistic", "hinge"):
        raise ValueError(loss)
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    base = df.select(F.col(features).alias("_v"), y.alias("_y"))
    w: list[float] | None = None
    hist: list[list[float]] = []
    with persisted(base):
        for i in range(1, iterations + 1):
            if w is None:
                m = F.lit(0.0)
            else:
                wl = F.array(*[F.lit(x) for x in w])
                m = F.aggregate(F.zip_with(vector_to_array(F.col("_v")), wl, lambda a, b: a * b),
                                F.lit(0.0), lambda acc, v: acc + v)
            if loss == "logistic":
                mult = 1.0 / (1.0 + F.exp(-m)) - F.col("_y")
            else:
                ys = 2.0 * F.col("_y") - 1.0
                mult = F.when(F.lit(1.0) > ys * m, -ys).otherwise(0.0)
            row = (base.withColumn("_m", mult)
                   .select(Summarizer.sum(F.col("_v"), 1.0 + F.greatest(F.col("_m"), F.lit(0.0))).alias("gp"),
                           Summarizer.sum(F.col("_v"), 1.0 + F.greatest(-F.col("_m"), F.lit(0.0))).alias("gn"),
                           F.count(F.lit(1)).alias("n"))
                   .first())
            n = row["n"]
            if not n:
                break
            g = (row["gp"].toArray() - row["gn"].toArray()) / n
            if w is None:
                w = [0.0] * len(g)
            st = step / math.sqrt(i)
            shrink = 1.0 - st * reg if loss == "hinge" else 1.0
            w = [wj * shrink - st * float(gj) for wj, gj in zip(w, g)]
            hist.append(list(w))
    return LinearSgdModel(w or [], loss, hist)


def sgd_oracle_sql(table_sql: str, d: int, loss: str, iterations: int, step: float = 1.0,
                   reg: float = 0.0) -> str:
    """DuckDB text computing the same weight history from ``table_sql`` (columns y, x0..x{d-1})."""
    ctes = [f"t as ({table_sql})",
            "w0 as (select " + ", ".join(f"0.0::double as w{j}" for j in range(d)) + ")"]
    for i in range(1, iterations + 1):
        m = " + ".join(f"t.x{j} * w{i-1}.w{j}" for j in range(d))
        if loss == "logistic":
            mult = f"(1.0 / (1.0 + exp(-({m}))) - t.y)"
            shrink = "1.0"
        else:
            mult = f"(case when 1.0 > (2.0 * t.y - 1.0) * ({m}) then -(2.0 * t.y - 1.0) else 0.0 end)"
            shrink = f"(1.0 - {step} / sqrt({i}) * {reg})"
        sel = ", ".join(f"max(w{i-1}.w{j}) * {shrink} - {step} / sqrt({i}) * sum({mult} * t.x{j}) / count(*) as w{j}"
                        for j in range(d))
        ctes.append(f"w{i} as (select {sel} from t, w{i-1})")
    union = " union all ".join(
        f"select {i} as iteration, " + ", ".join(f"round(w{j}, 8) as w{j}" for j in range(d)) + f" from w{i}"
        for i in range(1, iterations + 1))
    return "with " + ",\n".join(ctes) + "\n" + union
