"""Metrics as aggregates over a scored table.

Every metric is one (partial + final) aggregate over the scored rows. Rank metrics (E5, E6)
first reduce rows to one row per distinct score, then use bucketed running totals, so neither
raw rows nor all scores ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auger.operators.running import running_totals
from auger.session import materialize


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mismatches(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Rows whose prediction differs from the label (null-safe)."""
    return scored.where(~F.col(prediction).eqNullSafe(F.col(label)))


def test_error(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """E1 + E9: mismatches / rows, in one pass."""
    return scored.agg(
        F.avg(F.when(F.col(prediction).eqNullSafe(F.col(label)), 0.0).otherwise(1.0)).alias("test_error"),
        F.count(F.lit(1)).alias("n_rows"))


def mse(scored: DataFrame, prediction: str | Column = "prediction", label: str | Column = "label",
        name: str = "mse") -> DataFrame:
    """Mean squared error. Over class indexes this is the misclassification rate (``mse_class``)."""
    d = _c(label).cast("double") - _c(prediction).cast("double")
    return scored.agg(F.try_divide(F.sum(d * d), F.count(F.lit(1))).alias(name),
                      F.sum(d * d).alias("sse"), F.count(F.lit(1)).alias("n_rows"))


def confusion(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """``(label, prediction, n)``."""
    return (scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_wide(scored: DataFrame, prediction: str = "prediction", label: str = "label",
                   classes: list | None = None) -> DataFrame:
    """E3, printed form: one row per label, one column per predicted class. ``classes`` (the model's
    own list) names the columns; without it the distinct predictions are looked up first."""
    return scored.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1))).na.fill(0)


def accuracy(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """E4."""
    return scored.agg(F.avg(F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))


def _score_table(scored: DataFrame, score: str, label: str, positive: float) -> DataFrame:
    # rows without a score have no place in a ranking: they are left out of it as a whole
    return (scored.where(F.col(score).cast("double").isNotNull()).groupBy(F.col(score).cast("double").alias("p"))
            .agg(F.count(F.lit(1)).alias("cnt"),
                 F.sum(F.when(F.col(label) == F.lit(positive), 1).otherwise(0)).alias("pos")))


def score_table(scored: DataFrame, score: str = "p1", label: str = "label", positive: float = 1.0) -> DataFrame:
    """One row per distinct score ``(p, cnt, pos)``, materialised once in the checkpoint folder;
    pass it as ``table=`` to :func:`auc` and :func:`threshold_sweep` to share it."""
    return _score_table(scored, score, label, positive).transform(materialize)


def auc(scored: DataFrame | None = None, score: str = "p1", label: str = "label", positive: float = 1.0,
        table: DataFrame | None = None) -> DataFrame:
    """E5: area under ROC, tie-aware (rank-sum with mid ranks), exact.

    AUC = (sum over positives of rank - np(np+1)/2) / (np * nn). Rows with a null score are left out;
    :func:`unscored` counts them.
    """
    g = table if table is not None else score_table(scored, score, label, positive)
    run = running_totals(g, "p", ["cnt"])
    res = run.agg(
        F.sum(F.col("pos") * (F.col("cnt_run") - F.col("cnt") + (F.col("cnt") + 1) / 2.0)).alias("rs"),
        F.sum("pos").cast("double").alias("np"), (F.sum("cnt") - F.sum("pos")).cast("double").alias("nn"))
    # null (not an error) when one class is absent
    return res.select(F.try_divide(F.col("rs") - F.col("np") * (F.col("np") + 1) / 2.0,
                                   F.col("np") * F.col("nn")).alias("auc"))


def unscored(scored: DataFrame, score: str = "p1") -> DataFrame:
    """``n_unscored, n_rows``: the rows that rank metrics leave out, and all rows."""
    return scored.agg(F.count(F.when(F.col(score).cast("double").isNull(), 1)).alias("n_unscored"), F.count(F.lit(1)).alias("n_rows"))


def threshold_sweep(scored: DataFrame | None = None, score: str = "p1", label: str = "label",
                    positive: float = 1.0, table: DataFrame | None = None) -> DataFrame:
    """For every distinct score ``thr``, predict positive when score >= thr:
    ``thr, tp, fp, fn, tn, f1, accuracy, precision, tpr, fpr`` (``fpr, tpr`` are the ROC curve).
    One row per distinct score; rows with a null score are left out (:func:`unscored`)."""
    g = table if table is not None else score_table(scored, score, label, positive)
    run = running_totals(g, "p", ["cnt", "pos"], descending=True)
    pp, tp, np_, tot = F.col("cnt_run"), F.col("pos_run"), F.col("pos_total"), F.col("cnt_total")
    fp = pp - tp
    fn = np_ - tp
    tn = tot - np_ - fp
    return run.select(F.col("p").alias("thr"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                      F.try_divide(2.0 * tp, pp + np_).alias("f1"), F.try_divide(tp + tn, tot).alias("accuracy"),
                      F.try_divide(tp, pp).alias("precision"), F.try_divide(tp, np_).alias("tpr"),
                      F.try_divide(fp, tot - np_).alias("fpr"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1 (lowest threshold on ties) - a top-1 report."""
    return sweep.orderBy(F.col("f1").desc(), F.col("thr").asc()).limit(1)


def summary(scored: DataFrame, prediction: str = "prediction", label: str = "label",
            prob: str | None = None, positive: float = 1.0) -> DataFrame:
    """E1, E2, E4, E9 (and the probability MSE) in one aggregate: one pass over the scored rows."""
    y, pr = F.col(label).cast("double"), F.col(prediction).cast("double")
    n = F.count(F.lit(1))
    aggs = [F.avg(F.when(pr.eqNullSafe(y), 0.0).otherwise(1.0)).alias("test_error"),
            F.try_divide(F.sum((y - pr) * (y - pr)), n).alias("mse_class"),
            F.avg(F.when(pr == y, 1.0).otherwise(0.0)).alias("accuracy"),
            n.alias("n_rows")]
    if prob:
        yp = F.when(F.col(label) == F.lit(positive), 1.0).otherwise(0.0)
        dp = yp - F.col(prob).cast("double")
        aggs.append(F.try_divide(F.sum(dp * dp), n).alias("mse_prob"))
    return scored.agg(*aggs)


def class_priors(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n, prior)``; the total is a scalar subquery over the grouped table."""
    g = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("prior", F.col("n") / g.agg(F.sum("n")).scalar())


def glm_validation(scored: DataFrame, prob: str = "p1", label: str = "label", n_params: int = 1) -> DataFrame:
    """Binomial deviance report: null and residual deviance, log-loss, AIC, in one aggregate."""
    eps = 1e-15
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    ll = y * F.log(p) + (1 - y) * F.log(1 - p)
    agg = scored.agg(F.sum(ll).alias("ll"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n"))
    ybar = F.try_divide(F.col("sy"), F.col("n"))
    null_ll = F.col("sy") * F.log(ybar) + (F.col("n") - F.col("sy")) * F.log(1 - ybar)
    return agg.select(
        (-2 * null_ll).alias("null_deviance"),
        (-2 * F.col("ll")).alias("residual_deviance"),
        F.try_divide(-F.col("ll"), F.col("n")).alias("logloss"),
        (-2 * F.col("ll") + 2 * F.lit(n_params)).alias("aic"),
        F.col("n").alias("n_rows"))
