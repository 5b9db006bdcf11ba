"""Driver queries that check what models are made of: weights after a step, penalties, folds, rules, JSON."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from auger.functions.cleaning import wall_clock_hour
from auger.functions.encoding import LevelDictionary, assemble, encode_categorical
from auger.functions.hashing import hash_bucket, hash_bucket_sql
from auger.operators.learners.bayes import naive_bayes_fit
from auger.operators.learners.glm import cross_validate_glm, cross_validation_metrics, fit_glm
from auger.operators.learners.network import fit_network_averaged
from auger.operators.reports import pattern_rules
from auger.operators.scoring import network_importances, score
from auger.plans.catalog import query, table
from auger.plans.q_boosting import PURCHASE, _fit, _purchase, boosting_sql
from auger.plans.q_learners import _NB_BASE_SQL, _NB_FEATS, _event_features
from auger.session import materialize
from auger.sources.model_json import model_json

# ---------------------------------------------------------------- one step of a small network

START = np.array([0.5, -0.25, -1.0, 2.0, 0.1, -0.2, 1.0, -0.75, -0.5, 0.5, 0.0, 0.05])
_STEP_SQL = f"""
with x as (select user_id, avg(value) / 100 as a, avg(hour(ts)) / 24 as b, (count(*) filter (where event_type = 'purchase') * 5 > count(*))::integer as y
           from events group by user_id),
h as (select *, 0.5 * a - 1.0 * b + 0.1 as u0, -0.25 * a + 2.0 * b - 0.2 as u1 from x),
z as (select *, greatest(u0, 0) as h0, greatest(u1, 0) as h1, 1.0 * greatest(u0, 0) - 0.5 * greatest(u1, 0) as z0,
             -0.75 * greatest(u0, 0) + 0.5 * greatest(u1, 0) + 0.05 as z1 from h),
e as (select *, 1 / (1 + exp(z1 - z0)) - (y = 0)::integer as d0, 1 / (1 + exp(z0 - z1)) - (y = 1)::integer as d1 from z),
k as (select *, case when u0 > 0 then d0 - 0.75 * d1 else 0 end as e0, case when u1 > 0 then -0.5 * d0 + 0.5 * d1 else 0 end as e1 from e),
g as (select unnest([avg(a * e0), avg(a * e1), avg(b * e0), avg(b * e1), avg(e0), avg(e1),
                     avg(h0 * d0), avg(h0 * d1), avg(h1 * d0), avg(h1 * d1), avg(d0), avg(d1)]) as g,
             unnest({START.tolist()}::double[]) as w0, unnest(range(12)) as i from k),
w as (select i, w0 - sqrt(1e-8) / sqrt(0.01 * g * g + 1e-8) * g as w from g)
"""


def _one_step(spark, d):
    """Users with at least a fifth of purchases or not, by mean value and hour; all rows in one batch of one task."""
    ev = table(spark, d, "events").withColumn("h", wall_clock_hour(table(spark, d, "events"), "ts"))
    users = ev.groupBy("user_id").agg(
        (F.avg("value") / 100).alias("a"), (F.avg("h") / 24).alias("b"),
        (F.count_if(F.col("event_type") == "purchase") * 5 > F.count(F.lit(1))).cast("int").alias("label"))
    rows = users.select(array_to_vector(F.array("a", "b")).alias("features"), "label")
    return fit_network_averaged(rows, 2, 2, hidden=(2,), epochs=1, batch=1 << 30, rows_per_task=1 << 30, start=START)


@query("network_one_step", "H9", sql=_STEP_SQL + "select i::integer as i, round(w, 8) as weight from w")
def network_one_step(spark, d):
    """All weights after one full-batch ADADELTA step from given ones."""
    net = _one_step(spark, d)
    return spark.createDataFrame([(i, round(float(w), 8)) for i, w in enumerate(net.theta)], "i int, weight double")


@query("network_importances", "F5", sql=_STEP_SQL + """,
p as (select list(abs(w) order by i) as v from w),
m as (select unnest([v[1], v[3]]) as l0, unnest([v[2], v[4]]) as l1, unnest(['a', 'b']) as feature, v[1] + v[3] as s0, v[2] + v[4] as s1,
             v[7] / (v[7] + v[9]) + v[8] / (v[8] + v[10]) as o0, v[9] / (v[7] + v[9]) + v[10] / (v[8] + v[10]) as o1 from p),
t as (select feature, l0 / s0 * o0 + l1 / s1 * o1 as t from m)
select feature, round(t / sum(t) over (), 8) as importance from t
""")
def network_importances_q(spark, d):
    """Importances of the inputs by the absolute weights of the network after that step."""
    out = network_importances(spark, _one_step(spark, d), ["a", "b"])
    return out.withColumn("importance", F.round("importance", 8))


# ---------------------------------------------------------------- penalised and cross-validated GLM

def _xy(spark, d):
    ev = table(spark, d, "events")
    rows = ev.select("event_id", (F.col("value") / 100).alias("x0"), (wall_clock_hour(ev, "ts") / 24).alias("x1"),
                     F.get_json_object("props", "$.k").cast("double").alias("x2"),
                     F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"))
    return assemble(rows, ["x0", "x1", "x2"]).transform(materialize)


@query("glm_penalty", "H5", sql="""
select count(*) as n, unnest(['(intercept)', 'x0', 'x1', 'x2']) as term, 0.0::double as violation from events
""")
def glm_penalty(spark, d):
    """Elastic net (lambda 0.002, alpha 0.5): how far each coefficient is from its subgradient condition."""
    lam, alpha = 0.002, 0.5
    xy = _xy(spark, d)
    m = fit_glm(xy, "features", "label", alpha, lam, False, 100, 1e-10)
    terms = {"(intercept)": (F.lit(1.0), None)} | {f"x{j}": (F.col(f"x{j}"), float(b)) for j, b in enumerate(m.coefficients)}
    r = m.transform(xy).withColumn("r", F.col("p1") - F.col("label"))
    g = r.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("r") * x).alias(t) for t, (x, _) in terms.items()]).first()
    out = []
    for t, (_, b) in terms.items():
        if b is None:
            v = abs(g[t])
        elif b == 0:
            v = max(abs(g[t]) - lam * alpha, 0.0)
        else:
            v = abs(g[t] + lam * (1 - alpha) * b + lam * alpha * np.sign(b))
        out.append((g["n"], t, abs(round(float(v), 6))))
    return spark.createDataFrame(out, "n long, term string, violation double")


@query("glm_levels", "H6 B10", sql="""
select event_type as level, count(*) as n, 0.0::double as violation from events group by event_type
""")
def glm_levels(spark, d):
    """A ridge GLM on all levels of a column, none dropped: the score equation of every level's coefficient."""
    lam = 0.01
    ev = table(spark, d, "events").select("event_id", "event_type", (F.col("value") > 55).cast("double").alias("label"))
    enc = encode_categorical(["event_type"]).fit(ev)
    xy = enc.transform(ev).transform(materialize)
    m = fit_glm(xy, "event_type_vec", "label", 0.0, lam, False, 100, 1e-10)
    coef = F.element_at(F.array(*[F.lit(float(b)) for b in m.coefficients]), F.col("event_type_lvl").cast("int") + 1)
    total = xy.count()
    r = m.transform(xy).withColumn("b", coef).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("p1") - F.col("label")) / total + lam * F.first("b")).alias("g"))
    return r.select(F.col("event_type").alias("level"), "n", F.abs(F.round("g", 6)).alias("violation"))


_FOLDS = 5


@query("cv_fold_metrics", "H5", sql=f"""
with t as (select {hash_bucket_sql('event_id', _FOLDS)} as fold, (event_type = 'purchase')::integer as y from events),
f as (select fold, count(*) as n, sum(y) as s from t group by fold),
p as (select fold, ((select sum(s) from f) - s) / ((select sum(n) from f) - n) as p from f),
r as (select fold, y, p, ((p > 0.5)::integer = y)::integer as hit, -(y * ln(p) + (1 - y) * ln(1 - p)) as loss, (y - p) * (y - p) as sq from t join p using (fold))
select cast(fold as integer) as fold, count(*) as n, round(avg(hit), 8) as accuracy, round(avg(loss), 6) as log_loss, round(avg(sq), 6) as mse from r group by fold
union all select -1, count(*), round(avg(hit), 8), round(avg(loss), 6), round(avg(sq), 6) from r
""")
def cv_fold_metrics(spark, d):
    """Held-out metrics of each fold and of all, under a penalty that leaves only the folds' intercepts."""
    xy = _xy(spark, d).withColumn("fold", hash_bucket("event_id", _FOLDS))
    _, _, holdout = cross_validate_glm(xy, "fold", _FOLDS, alpha=1.0, lam=1e6, tol=1e-10)
    m = cross_validation_metrics(holdout, "fold")
    return m.select("fold", "n", F.round("accuracy", 8).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"), F.round("mse", 6).alias("mse"))


# ---------------------------------------------------------------- scoring, encoding, rules, JSON

_EXAMPLES = [("low", 1.0, 0.0, 5.0), ("night", 20.0, 23.0, 50.0), ("high", 400.0, 12.0, 1.0), ("none", 0.0, 0.0, 0.0)]


@query("literal_examples", "F3", sql=_NB_BASE_SQL + f"""
, x as (select * from (values {', '.join(map(str, _EXAMPLES))}) t(name, value, hour, k)),
s as (select name, label, row_number() over (partition by name order by lp + value * t0 + hour * t1 + k * t2 desc, label) as rn from x, m)
select name, label as prediction from s where rn = 1
""")
def literal_examples(spark, d):
    """Examples written in the program, scored by a model of the training events."""
    m = naive_bayes_fit(_event_features(spark, d).where(F.col("_b") < 8), _NB_FEATS, "event_type")
    rows = spark.createDataFrame(_EXAMPLES, "name string, value double, hour double, k double")
    return score(m, rows).select("name", "prediction")


@query("level_codes", "B9 B10 E8", sql=f"""
with l as (select u, dense_rank() over (order by u) - 1 as code from (
  select distinct user_id::varchar as u from events where {hash_bucket_sql('event_id', 10)} < 2))
select event_id, cast(code as integer) as code from events left join l on u = user_id::varchar
""")
def level_codes(spark, d):
    """Level indexes of all events' users by a dictionary of a fifth of them; users not in it have none."""
    ev = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("u"))
    levels = LevelDictionary.fit(ev.where(hash_bucket("event_id", 10) < 2), ["u"])
    return levels.transform(ev, {"u": "code"}).select("event_id", "code")


@query("pattern_rules", "J3", sql="""
with t as (select 'hour=' || cast(floor(hour(ts) / 6) as integer) as a, 'value=' || cast(floor(value / 25) as integer) as b,
                  'weekday=' || isodow(ts) as c, event_type as class from events),
s as (select unnest([[a], [b], [c], [a, b], [a, c], [b, c], [a, b, c]]) as items, class from t),
n as (select items, class, count(*) as n from s group by all),
m as (select items, sum(n) as m from n group by items),
k as (select class, count(*) as k, (select count(*) from t) as total from t group by class)
select array_to_string(items, ' & ') as antecedent, class, n, round(n / total, 8) as support, round(n / m, 8) as confidence,
       round(n / m / (k / total), 8) as lift
from n join m using (items) join k using (class) where n >= ceil(0.004 * total)
""")
def pattern_rules_q(spark, d):
    """Frequent combinations of up to three binned columns as rules for the event's type."""
    ev = table(spark, d, "events")
    rows = ev.select(F.floor(wall_clock_hour(ev, "ts") / 6).cast("int").alias("hour"), F.floor(F.col("value") / 25).cast("int").alias("value"),
                     (F.weekday("ts") + 1).alias("weekday"), F.col("event_type").alias("class"))
    rules = pattern_rules(rows, ["hour", "value", "weekday"], "class", 0.004)
    return rules.select(F.concat_ws(" & ", "antecedent").alias("antecedent"), "class", "n",
                        *[F.round(c, 8).alias(c) for c in ("support", "confidence", "lift")])


@query("models_json", "F6", sql=boosting_sql(PURCHASE, 2, 1, 1, 0.5) + """,
leaf(side, t) as (select node, printf('{"rows":%d,"value":%.6f}', n, value) from leaf_0),
tree as (select '{"kind":"boosted_trees","classes":2,"rate":0.500000,"start":[' || printf('%.6f', (select any_value(f) from s0))
         || ']' || ',"rounds":[[{"rows":' || tn || case f when 0 then ',"feature":"value","cut":' || b
              else ',"feature":"user_id","levels":[' || (select string_agg(b, ',' order by b) from left_0_0) || ']' end
         || ',"left":' || (select t from leaf where side = 1) || ',"right":' || (select t from leaf where side = 2) || '}]]}' as json from split_0_0),
""" + _NB_BASE_SQL.replace("with t as", "t as") + """
select 'boosted_trees' as kind, json from tree
union all select 'naive_bayes', '{"kind":"naive_bayes","features":["value","hour","k"],"classes":[' || string_agg(
  printf('{"label":"%s","log_prior":%.6f,"log_theta":[%.6f,%.6f,%.6f]}', label, lp, t0, t1, t2), ',' order by label) || ']}' from m
""")
def models_json(spark, d):
    """A boosted tree with one cut and a naive Bayes model as JSON text."""
    nb = naive_bayes_fit(_event_features(spark, d).where(F.col("_b") < 8), _NB_FEATS, "event_type")
    tree = _fit(spark, d, _purchase(), rounds=1, depth=1, rate=0.5)
    return spark.createDataFrame([("boosted_trees", model_json(spark, tree)), ("naive_bayes", model_json(spark, nb))], "kind string, json string")
