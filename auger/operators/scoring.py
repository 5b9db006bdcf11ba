"""Scoring and model inspection.

Scoring is a projection over the input (``transform``): predictions stay distributed and are
written by the sinks, never collected.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def score(model, df: DataFrame, n_classes: int | None = None, prob_col: str = "probability",
          keep: list[str] | None = None) -> DataFrame:
    """``prediction`` plus one probability column per class (``p0``, ``p1``, …)."""
    out = model.transform(df)
    if prob_col in out.columns:
        k = n_classes or getattr(model, "numClasses", None)
        if k is None:
            raise ValueError("n_classes needed")
        arr = vector_to_array(F.col(prob_col))
        out = out.withColumns({f"p{i}": arr[i] for i in range(k)})
    drop = [c for c in ("rawPrediction", prob_col) if c in out.columns]
    out = out.drop(*drop)
    if keep is not None:
        out = out.select(*keep, "prediction", *[c for c in out.columns if c.startswith("p") and c[1:].isdigit()])
    return out


def importances(spark: SparkSession, model, names: list[str] | None = None) -> DataFrame:
    """tree variable importances (normalised to sum 1), one row per feature."""
    imp = model.featureImportances.toArray().tolist()
    names = names or [f"f{i}" for i in range(len(imp))]
    return spark.createDataFrame([(names[i], float(v)) for i, v in enumerate(imp)],
                                 "feature string, importance double")


def describe(spark: SparkSession, model, names: list[str] | None = None) -> DataFrame:
    """the model as text (trees), as a coefficient table (linear models) or, for the other models of this
    package, as JSON; :func:`auger.sources.model_json.model_json` gives JSON for each."""
    if hasattr(model, "coefficients"):
        coef = [float(c) for c in getattr(model.coefficients, "toArray", lambda: model.coefficients)()]
        names = names or [f"f{i}" for i in range(len(coef))]
        rows = [(n, float(c)) for n, c in zip(names, coef)]
        if hasattr(model, "intercept"):
            rows.append(("(intercept)", float(model.intercept)))
        return spark.createDataFrame(rows, "term string, coefficient double")
    text = getattr(model, "toDebugString", None)
    if text is None:
        from auger.sources.model_json import model_json
        text = model_json(spark, model, names)
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


def network_importances(spark: SparkSession, model, names: list[str] | None = None) -> DataFrame:
    """the importances of a network's inputs from its weights, as the original reports them."""
    from auger.operators.learners.network import weight_importances
    values = weight_importances(model).tolist()
    return spark.createDataFrame(list(zip(names or [f"f{i}" for i in range(len(values))], values)), "feature string, importance double")


def score_each_iteration(spark: SparkSession, gbt_model, df: DataFrame) -> DataFrame:
    """F8: the model's loss after every boosting iteration (one distributed pass)."""
    vals = gbt_model.evaluateEachIteration(df)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(vals)], "iteration int, loss double")


def permuted_copies(df: DataFrame, features: str, n_features: int, seed: int = 7,
                    which: list[int] | None = None, group_rows: int = 1024) -> DataFrame:
    """One copy of ``df`` per feature j (column ``_perm_j``; ``-1`` = unpermuted baseline) in
    which slot j is permuted among the rows.

    The permutation is a cyclic shift inside random groups of about ``group_rows`` rows: one window over
    the plain rows hands each row the whole vector of the one before it, so the rows are shuffled once,
    and the copies are made after that, in the same stage. No task ever holds more than one group.
    """
    which = list(range(n_features)) if which is None else which
    n = df.count()
    n_groups = max(1, math.ceil(n / group_rows))
    rep = (df.withColumn("_farr", vector_to_array(F.col(features)))
           .withColumn("_key", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns if c != features], "_farr"))
           .withColumn("_grp", F.pmod(F.col("_key"), F.lit(n_groups)).cast("int"))
           .withColumn("_ord", F.xxhash64(F.lit(seed + 1), "_key")))
    w = Window.partitionBy("_grp").orderBy("_ord")  # equal rows are interchangeable
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.coalesce(F.lag("_farr", 1).over(w), F.last("_farr").over(wall))
    copies = rep.withColumn("_pv", prev).withColumn("_perm_j", F.explode(F.array(*[F.lit(j) for j in [-1, *which]])))
    out = copies.withColumn(
        "_farr", F.transform("_farr", lambda x, i: F.when(i == F.col("_perm_j"), F.element_at("_pv", i + 1)).otherwise(x)))
    return out.withColumn(features, array_to_vector("_farr")).drop("_farr", "_pv", "_key", "_grp", "_ord")


def permutation_importance(spark: SparkSession, model, df: DataFrame, features: str = "features",
                           label: str = "label", n_features: int | None = None,
                           names: list[str] | None = None, seed: int = 7) -> DataFrame:
    """accuracy drop when one feature is shuffled, for every feature, in one Spark job.

    For any model; the original's own measure for networks is :func:`network_importances`. The permutation
    goes by a hash of the row, so it is the same on any partitioning.
    """
    n_features = n_features or len(df.select(vector_to_array(F.col(features))).first()[0])
    names = names or [f"f{i}" for i in range(n_features)]
    copies = permuted_copies(df.select(features, label), features, n_features, seed)
    scored = model.transform(copies)
    acc = scored.groupBy("_perm_j").agg(
        F.avg(F.when(F.col("prediction") == F.col(label), 1.0).otherwise(0.0)).alias("acc"))
    # acc has one row per feature (+ baseline): a window over it is a window over d + 1 rows
    with_base = acc.withColumn("base_acc", F.max(F.when(F.col("_perm_j") == -1, F.col("acc")))
                               .over(Window.partitionBy()))
    name_map = F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(j), F.lit(n))])
    return (with_base.where(F.col("_perm_j") >= 0)
            .select(F.element_at(name_map, F.col("_perm_j")).alias("feature"),
                    (F.col("base_acc") - F.col("acc")).alias("importance")))
