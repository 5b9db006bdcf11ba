"""Driver queries for metrics (C1, E1-E6, E10) over a rule-scored events table.

The rule: label = 1 for ``purchase`` events; score = ``round(value, 0)``; predicted
positive when the score is at least 60. The events carry no signal; the point is exact metric
arithmetic on 10^4 .. 10^5 rows with many tied scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auger.operators import metrics as M
from auger.plans.catalog import query, table

_BASE_SQL = """
with s as (
  select event_id, case when event_type = 'purchase' then 1.0 else 0.0 end::double as label,
         round(value, 0) as p, case when round(value, 0) >= 60 then 1.0 else 0.0 end::double as prediction
  from events)
"""


def scored_events(spark, d):
    ev = table(spark, d, "events")
    p = F.round(F.col("value"), 0)
    return ev.select("event_id",
                     F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"),
                     p.alias("p"),
                     F.when(p >= 60, 1.0).otherwise(0.0).alias("prediction"))


@query("mismatches", "C1", sql=_BASE_SQL + "select event_id, label, prediction from s where label <> prediction")
def mismatches_q(spark, d):
    return M.mismatches(scored_events(spark, d)).select("event_id", "label", "prediction")


@query("test_error", "E1 E9", sql=_BASE_SQL + """
select round(avg(case when label = prediction then 0.0 else 1.0 end), 10) as test_error, count(*) as n_rows from s
""")
def test_error_q(spark, d):
    return M.test_error(scored_events(spark, d)).select(F.round("test_error", 10).alias("test_error"), "n_rows")


@query("mse", "E2", sql=_BASE_SQL + """
select round(sum((label - prediction) * (label - prediction)) / count(*), 10) as mse_class,
       round(sum((label - p / 500.0) * (label - p / 500.0)) / count(*), 10) as mse_prob
from s
""")
def mse_q(spark, d):
    s = scored_events(spark, d)
    dc = F.col("label") - F.col("prediction")
    dp = F.col("label") - F.col("p") / 500.0
    return s.agg(F.round(F.sum(dc * dc) / F.count(F.lit(1)), 10).alias("mse_class"),
                 F.round(F.sum(dp * dp) / F.count(F.lit(1)), 10).alias("mse_prob"))


@query("confusion", "E3", sql=_BASE_SQL + "select label, prediction, count(*) as n from s group by all")
def confusion_q(spark, d):
    return M.confusion(scored_events(spark, d))


@query("accuracy", "E4", sql=_BASE_SQL + """
select round(avg(case when label = prediction then 1.0 else 0.0 end), 10) as accuracy from s
""")
def accuracy_q(spark, d):
    return M.accuracy(scored_events(spark, d)).select(F.round("accuracy", 10).alias("accuracy"))


@query("auc", "E5", sql=_BASE_SQL + """
, r as (select p, count(*) as cnt, sum(label) as pos from s group by p),
c as (select p, cnt, pos, sum(cnt) over (order by p) - cnt as below from r),
t as (select sum(pos) as np, sum(cnt) - sum(pos) as nn from r)
select round((sum(pos * (below + (cnt + 1) / 2.0)) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 10) as auc
from c, t
""")
def auc_q(spark, d):
    return M.auc(scored_events(spark, d), "p", "label").select(F.round("auc", 10).alias("auc"))


_SWEEP_SQL = _BASE_SQL + """
, r as (select p, count(*) as cnt, sum(label) as pos from s group by p),
c as (select p, sum(cnt) over (order by p desc) as pp, sum(pos) over (order by p desc) as tp from r),
t as (select sum(pos) as np, sum(cnt) as tot from r),
w as (select p as thr, cast(tp as bigint) as tp, cast(pp - tp as bigint) as fp, cast(np - tp as bigint) as fn,
             cast(tot - np - (pp - tp) as bigint) as tn,
             round(2.0 * tp / (pp + np), 10) as f1, round((tp + tot - np - (pp - tp)) / tot, 10) as accuracy,
             round(tp / pp, 10) as precision, round(tp / np, 10) as tpr, round((pp - tp) / (tot - np), 10) as fpr
      from c, t)
"""


@query("threshold_sweep", "E6", sql=_SWEEP_SQL + "select * from w")
def threshold_sweep_q(spark, d):
    sw = M.threshold_sweep(scored_events(spark, d), "p", "label")
    return sw.select("thr", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
                     *[F.round(c, 10).alias(c) for c in ("f1", "accuracy", "precision", "tpr", "fpr")])


@query("best_threshold", "E6 E4", sql=_SWEEP_SQL + "select * from w order by f1 desc, thr limit 1")
def best_threshold_q(spark, d):
    return M.best_threshold(threshold_sweep_q(spark, d))


@query("glm_deviance", "E10", sql="""
with s as (select case when event_type = 'purchase' then 1.0 else 0.0 end as y,
                  1.0 / (1.0 + exp(-(-1.6 + 0.004 * value))) as p1 from events),
a as (select sum(y * ln(p1) + (1 - y) * ln(1 - p1)) as ll, sum(y) as sy, count(*) as n from s)
select round(-2 * (sy * ln(sy / n) + (n - sy) * ln(1 - sy / n)), 6) as null_deviance,
       round(-2 * ll, 6) as residual_deviance, round(-ll / n, 10) as logloss,
       round(-2 * ll + 4, 6) as aic, n as n_rows
from a
""")
def glm_deviance_q(spark, d):
    ev = table(spark, d, "events")
    s = ev.select(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"),
                  (1.0 / (1.0 + F.exp(-(F.lit(-1.6) + F.lit(0.004) * F.col("value"))))).alias("p1"))
    g = M.glm_validation(s, "p1", "label", n_params=2)
    return g.select(F.round("null_deviance", 6).alias("null_deviance"),
                    F.round("residual_deviance", 6).alias("residual_deviance"),
                    F.round("logloss", 10).alias("logloss"), F.round("aic", 6).alias("aic"), "n_rows")
