"""Driver queries for learners, scoring and model inspection.

Exact queries (naive Bayes model, scores and confusion, the two SGD trainers, the first-split
gini table, the streamed scoring) carry DuckDB oracles. Queries over trained Spark ML models have none: the driver checks their row counts,
and ``tests/`` checks that they beat the majority class where the data carries signal.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.functions.cleaning import wall_clock_hour
from auger.functions.features import hashing_tf, tokens
from auger.functions.hashing import hash_bucket, hash_bucket_sql
from auger.operators import scoring as S
from auger.operators.learners import builtin as B
from auger.operators.learners.bayes import naive_bayes_fit
from auger.operators.learners.boosting import fit_boosting
from auger.operators.learners.sgd import sgd_linear, sgd_linear_vector, sgd_oracle_sql, vector_features
from auger.operators.reports import rule_table
from auger.operators.running import running_totals
from auger.plans.catalog import query, table
from auger.session import materialize, write_scratch

N_HASH = 100

# ---------------------------------------------------------------- events: exact learners

_TRAIN = f"{hash_bucket_sql('event_id', 10)} < 8"
_TEST = f"{hash_bucket_sql('event_id', 10)} >= 8"
_NB_FEATS = ["value", "hour", "k"]


def _event_features(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select("event_id", "event_type",
                     F.col("value").cast("double").alias("value"),
                     wall_clock_hour(ev, "ts").cast("double").alias("hour"),
                     F.get_json_object("props", "$.k").cast("double").alias("k"),
                     hash_bucket("event_id", 10).alias("_b"))


_EV_FEATS_SQL = """select event_id, event_type, value, cast(hour(ts) as double) as hour,
       cast(json_extract_string(props, '$.k') as double) as k from events"""

_NB_BASE_SQL = f"""
with t as ({_EV_FEATS_SQL} where {_TRAIN}),
c as (select event_type as label, count(*) as n_c, sum(value) as s0, sum(hour) as s1, sum(k) as s2 from t group by all),
tot as (select sum(n_c) as n, count(*) as kk from c),
m as (select label, ln(n_c + 1.0) - ln(n + kk) as lp, ln(s0 + 1.0) - ln(s0 + s1 + s2 + 3.0) as t0,
             ln(s1 + 1.0) - ln(s0 + s1 + s2 + 3.0) as t1, ln(s2 + 1.0) - ln(s0 + s1 + s2 + 3.0) as t2 from c, tot)
"""


@query("naive_bayes_model", "H2", sql=_NB_BASE_SQL + """
select label, 'value' as feature, round(lp, 8) as log_prior, round(t0, 8) as log_theta from m
union all select label, 'hour', round(lp, 8), round(t1, 8) from m
union all select label, 'k', round(lp, 8), round(t2, 8) from m
""")
def naive_bayes_model_q(spark, d):
    ev = _event_features(spark, d)
    m = naive_bayes_fit(ev.where(F.col("_b") < 8), _NB_FEATS, "event_type")
    return m.to_frame(spark).select("label", "feature", F.round("log_prior", 8).alias("log_prior"),
                                    F.round("log_theta", 8).alias("log_theta"))


NB_SCORED_SQL = _NB_BASE_SQL + f"""
, te as ({_EV_FEATS_SQL} where {_TEST}),
sc as (select te.event_id, te.event_type, m.label, lp + value * t0 + hour * t1 + k * t2 as s from te, m),
r as (select event_id, event_type, label, row_number() over (partition by event_id order by s desc, label) as rn
      from sc),
scored as (select event_id, event_type, label as prediction from r where rn = 1)
"""


@query("naive_bayes_score", "H2 F1 F2", sql=NB_SCORED_SQL + "select event_id, prediction from scored")
def naive_bayes_score_q(spark, d):
    ev = _event_features(spark, d)
    m = naive_bayes_fit(ev.where(F.col("_b") < 8), _NB_FEATS, "event_type")
    return m.transform(ev.where(F.col("_b") >= 8)).select("event_id", "prediction")


@query("flagship_confusion", "A1 D2 H2 F1 E3", sql=NB_SCORED_SQL + """
select event_type as label, prediction, count(*) as n from scored group by all
""")
def flagship_confusion(spark, d):
    """Naive Bayes trained on the hash-split training part of events, confusion on the rest."""
    ev = _event_features(spark, d)
    m = naive_bayes_fit(ev.where(F.col("_b") < 8), _NB_FEATS, "event_type")
    sc = m.transform(ev.where(F.col("_b") >= 8))
    return sc.groupBy(F.col("event_type").alias("label"), "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("confusion_wide", "E3", sql=NB_SCORED_SQL + """
select event_type as label,
       count(*) filter (where prediction = 'click') as click, count(*) filter (where prediction = 'error') as error,
       count(*) filter (where prediction = 'purchase') as purchase, count(*) filter (where prediction = 'signup') as signup,
       count(*) filter (where prediction = 'view') as view
from scored group by event_type
""")
def confusion_wide_q(spark, d):
    """E3 in its printed form: one row per true class, one column per predicted class."""
    from auger.operators.metrics import confusion_wide
    ev = _event_features(spark, d)
    m = naive_bayes_fit(ev.where(F.col("_b") < 8), _NB_FEATS, "event_type")
    sc = m.transform(ev.where(F.col("_b") >= 8)).withColumnRenamed("event_type", "label")
    return confusion_wide(sc, "prediction", "label", m.labels)


_SGD_TABLE = (f"select (case when event_type = 'purchase' then 1.0 else 0.0 end)::double as y, "
              f"value / 100.0 as x0, hour(ts) / 24.0 as x1 from events where {_TRAIN}")


def _sgd_history(spark, d, loss, reg):
    ev = _event_features(spark, d).where(F.col("_b") < 8)
    y = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    m = sgd_linear(ev, [F.col("value") / 100.0, F.col("hour") / 24.0], y, loss, iterations=5, step=1.0, reg=reg)
    h = m.history_frame(spark)
    return h.select("iteration", F.round("w0", 8).alias("w0"), F.round("w1", 8).alias("w1"))


@query("logistic_sgd", "H3 D5", sql=sgd_oracle_sql(_SGD_TABLE, 2, "logistic", 5))
def logistic_sgd_q(spark, d):
    return _sgd_history(spark, d, "logistic", 0.0)


@query("svm_sgd", "H4", sql=sgd_oracle_sql(_SGD_TABLE, 2, "hinge", 5, 1.0, 0.01))
def svm_sgd_q(spark, d):
    return _sgd_history(spark, d, "hinge", 0.01)


# ---------------------------------------------------------------- first-split gini

_GINI_FEATS = {"hour": "hour", "value_bin": "value_bin", "k": "k"}


@query("first_split_gini", "J3", sql="""
with f as (
  select event_type as c, 'hour' as feature, cast(hour(ts) as double) as v from events
  union all select event_type, 'value_bin', floor(value / 50.0) from events
  union all select event_type, 'k', cast(json_extract_string(props, '$.k') as double) from events),
cells as (select feature, v, c, count(*) as n from f group by all),
thr as (select distinct feature, v as t from cells),
tot as (select feature, c, sum(n) as nc from cells group by all),
nall as (select feature, sum(n) as nn from cells group by all),
lc as (select thr.feature, thr.t, tot.c, tot.nc,
              coalesce((select sum(n) from cells where cells.feature = thr.feature and cells.c = tot.c
                        and cells.v <= thr.t), 0) as l
       from thr join tot on thr.feature = tot.feature),
g as (select lc.feature, t, cast(sum(l) as bigint) as nl, cast(sum(nc - l) as bigint) as nr,
             cast(sum(l * l) as bigint) as sl2, cast(sum((nc - l) * (nc - l)) as bigint) as sr2
      from lc group by all),
s as (select g.feature, t, nl, 1.0 - (sl2 / nl + sr2 / nr) / nn as gini
      from g join nall on g.feature = nall.feature where nr > 0)
select feature, t as threshold, round(gini, 10) as gini, nl as n_left
from (select *, row_number() over (partition by feature order by round(gini, 12), t) as rn from s) where rn = 1
""")
def first_split_gini_q(spark, d):
    """Best first split per (binned) feature by weighted gini; one pass + per-feature windows.

    Running sums over each feature's distinct values give the left side of every threshold.
    """
    ev0 = table(spark, d, "events")
    ev = ev0.select(
        F.col("event_type").alias("c"),
        wall_clock_hour(ev0, "ts").cast("double").alias("hour"),
        F.floor(F.col("value") / 50.0).cast("double").alias("value_bin"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    return first_split_table(ev, list(_GINI_FEATS), "c")


def first_split_table(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Weighted gini of every candidate first split ``x <= t`` at every distinct value, best per feature.

    Exact whatever the number of distinct values: the class counts left of each value come from running
    sums over range buckets, so no task holds a whole feature. Rows with a null value are below every
    threshold and give none themselves; a null class is a class of its own."""
    cells = df.select(F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("_c"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias("v"))
        for f in features])).alias("kv")).groupBy("kv.feature", "kv.v", "_c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # the squared class counts left and right of a value change at that class's own values only; the
    # changes are summed over the classes of a value and then run up in a second pass
    run = running_totals(cells.transform(materialize), "v", ["n"], by=["feature", "_c"])
    now, before, all_ = F.col("n_run"), F.col("n_run") - F.col("n"), F.col("n_total")
    steps = run.groupBy("feature", "v").agg(
        F.sum("n").alias("n"), F.sum(now * now - before * before).alias("l2"),
        F.sum((all_ - now) * (all_ - now) - (all_ - before) * (all_ - before)).alias("r2"))
    sums = running_totals(steps.transform(materialize), "v", ["n", "l2", "r2"], by=["feature"])
    nl, nr = F.col("n_run"), F.col("n_total") - F.col("n_run")
    right = F.col("r2_run") - F.col("r2_total")  # nothing is right of the last value
    gini = F.lit(1.0) - (F.col("l2_run") / nl + F.try_divide(right, nr)) / F.col("n_total")
    splits = sums.where((nr > 0) & (F.col("v") > float("-inf"))).select("feature", F.struct(
        F.round(gini, 12).alias("order"), F.col("v").alias("threshold"), gini.alias("gini"), nl.cast("long").alias("n_left")).alias("s"))
    best = splits.groupBy("feature").agg(F.min("s").alias("s"))
    return best.select("feature", "s.threshold", F.round("s.gini", 10).alias("gini"), "s.n_left")


_WIDE_SQL = """
with f as (select l_returnflag as c, case when l_linenumber = 7 then null else l_extendedprice end as v from lineitem),
cells as (select coalesce(v, '-infinity'::double) as v, c, count(*)::double as n from f group by all),
classes as (select c, sum(n) as t from cells group by c),
grid as (select d.v, k.c, k.t, coalesce(x.n, 0) as n from (select distinct v from cells) d, classes k
         left join cells x on x.v = d.v and x.c = k.c),
run as (select v, c, t, sum(n) over (partition by c order by v) as l from grid),
s as (select v, sum(l) as nl, sum(t) as nn, sum(l * l) as sl2, sum((t - l) * (t - l)) as sr2 from run group by v),
g as (select v, nl, 1.0 - (sl2 / nl + sr2 / (nn - nl)) / nn as gini from s where nn > nl and v > '-infinity'::double)
select 'l_extendedprice' as feature, v as threshold, round(gini, 10) as gini, cast(nl as bigint) as n_left
from g order by round(gini, 12), v limit 1
"""


@query("first_split_wide", "J3", sql=_WIDE_SQL)
def first_split_wide_q(spark, d):
    """Best first split of a feature with thousands of distinct values and nulls, without binning."""
    li = table(spark, d, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("l_extendedprice"))
    return first_split_table(li, ["l_extendedprice"], "l_returnflag")


# ---------------------------------------------------------------- documents: trained models

def doc_features(spark, d, n_features: int = N_HASH, docs: DataFrame | None = None) -> DataFrame:
    """Hashed whole-text token counts per document, language class index and split bucket."""
    if docs is None:
        docs = table(spark, d, "documents")
    docs = docs.select("doc_id", "lang", "source", "n_chars", tokens("text").alias("tokens"), *(
        ["label"] if "label" in docs.columns else []))
    levels = F.create_map(*[x for i, lv in enumerate(_lang_levels(spark, d)) for x in (F.lit(lv), F.lit(float(i)))])
    out = hashing_tf("tokens", n_features, "features").transform(docs).drop("tokens")
    return out.withColumn("lang_idx", F.element_at(levels, F.col("lang"))) \
              .withColumn("_b", hash_bucket("doc_id", 10))


def _lang_levels(spark, d, max_levels: int = 1000) -> list[str]:
    """The class domain of ``lang`` in text order (checked small: it becomes a literal map)."""
    levels = [r[0] for r in table(spark, d, "documents").select("lang").distinct().orderBy("lang")
              .limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"more than {max_levels} languages: too many classes")
    return levels


def labelled_docs(spark, d, n_features: int = N_HASH) -> DataFrame:
    """Documents joined to their quality labels (two classes, strong signal). The join comes
    first, so only labelled texts are tokenised."""
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").join(lab, "doc_id")
    return doc_features(spark, d, n_features, docs)


def _split(df: DataFrame):
    """Hash split. The feature rows are written once to the shared folder, by split bucket (texts are
    tokenised in one pass), so iterative learners re-read compact rows instead of re-tokenising
    whole texts on every pass; each side reads its own buckets only (partition filters)."""
    ck = write_scratch(df, "split", ("_b",))
    return ck.where(F.col("_b") < 8), ck.where(F.col("_b") >= 8)


def _scored(model, test, n_classes=2, label="label"):
    return S.score(model, test, n_classes).select("doc_id", F.col(label).alias("label"), "prediction",
                                                   *[f"p{i}" for i in range(n_classes)])


@query("spam_text", "A4 G1 G2 H3")
def spam_text_q(spark, d):
    """Hashed tokens -> logistic regression by SGD (20 iterations) -> test predictions."""
    tr, te = _split(labelled_docs(spark, d))
    m = sgd_linear_vector(tr, "features", "label", "logistic", iterations=20)
    return m.transform(te, vector_features("features", N_HASH)).select("doc_id", "label", "prediction", "p1")


@query("tree", "H1 F1")
def tree_q(spark, d):
    tr, te = _split(labelled_docs(spark, d))
    return _scored(B.decision_tree().fit(tr), te)


@query("glm_cv", "H5 D3")
def glm_cv_q(spark, d):
    """Elastic-net GLM by IRLS, 10-fold cross-validated (fold = hash of the key), scored on test."""
    from auger.operators.learners.glm import cross_validate_glm
    tr, te = _split(labelled_docs(spark, d))
    tr = tr.withColumn("fold", hash_bucket(F.concat(F.lit("f"), F.col("doc_id").cast("string")), 10))
    m, _, _ = cross_validate_glm(tr, "fold", 10, alpha=B.GLM_ALPHA, lam=B.GLM_LAMBDA)
    return m.transform(te).select("doc_id", "label", "prediction", "p0", "p1")


@query("glm_categorical", "H6 B10")
def glm_categorical_q(spark, d):
    """GLM as in the original's airline job: three categorical inputs with every level kept plus
    one numeric input (here the text length, there the distance), no standardising."""
    from pyspark.ml import Pipeline
    from auger.functions.encoding import assembler, encode_categorical
    from auger.operators.learners.glm import fit_glm
    df = labelled_docs(spark, d).withColumn("len_band", F.floor(F.log10(F.col("n_chars") + 1)).cast("string"))
    tr, te = _split(df)
    enc = encode_categorical(["source", "lang", "len_band"], drop_last=False)
    prep = Pipeline(stages=[*enc.getStages(),
                            assembler(["source_vec", "lang_vec", "len_band_vec", "n_chars"], "cat_features")]).fit(tr)
    m = fit_glm(prep.transform(tr), "cat_features", standardize=False, alpha=B.GLM_ALPHA, lam=B.GLM_LAMBDA)
    return m.transform(prep.transform(te)).select("doc_id", "label", "prediction", "p0", "p1")


@query("gbm", "H7 F1")
def gbm_q(spark, d):
    tr, te = _split(labelled_docs(spark, d))
    return _scored(B.gbm().fit(tr), te)


@query("gbm_newton", "H7")
def gbm_newton_q(spark, d):
    """Two-class boosting with the original's start value and Newton leaf values."""
    tr, te = _split(labelled_docs(spark, d))
    m = fit_boosting(tr, "features", "label", 2, rounds=10, depth=5, bins=20, rate=1.0)
    return m.transform(te).select("doc_id", "label", "prediction", "p0", "p1")


@query("gbm_multiclass", "H8")
def gbm_multiclass_q(spark, d):
    tr, te = _split(doc_features(spark, d))
    m = fit_boosting(tr, "features", "lang_idx", None, rounds=5, depth=5, bins=20, rate=1.0)
    return m.transform(te).select("doc_id", F.col("lang_idx").alias("label"), "prediction",
                                  *[f"p{i}" for i in range(m.n_classes)])


@query("network", "H9")
def network_q(spark, d):
    tr, te = _split(doc_features(spark, d))
    k = len(_lang_levels(spark, d))
    m = B.network(N_HASH, k, hidden=(16,), epochs=30, label="lang_idx").fit(tr)
    return _scored(m, te, k, label="lang_idx")


@query("network_reference", "H9")
def network_reference_q(spark, d):
    """The original's network shape: two hidden layers of 200, 10 iterations, its seed."""
    tr, te = _split(doc_features(spark, d))
    k = len(_lang_levels(spark, d))
    m = B.network(N_HASH, k, label="lang_idx").fit(tr)
    return _scored(m, te, k, label="lang_idx")


@query("network_rectifier", "H9")
def network_rectifier_q(spark, d):
    """The original's network semantics: rectifier units, ADADELTA (rho 0.99, eps 1e-8), two hidden
    layers of 200, 10 epochs, its seed, best epoch kept; trained by per-task local epochs and
    global averaging. Validation = the training part's bucket 7 (the test part is never looked at)."""
    from auger.operators.learners.network import fit_network_averaged
    tr, te = _split(doc_features(spark, d))
    fit, valid = tr.where(F.col("_b") < 7), tr.where(F.col("_b") == 7)
    k = len(_lang_levels(spark, d))
    m = fit_network_averaged(fit, N_HASH, k, label="lang_idx", valid=valid)
    return m.transform(te).select("doc_id", F.col("lang_idx").alias("label"), "prediction",
                                  *[f"p{i}" for i in range(k)])


@query("importances", "F4")
def importances_q(spark, d):
    tr, _ = _split(labelled_docs(spark, d))
    m = B.gbm().fit(tr)
    return S.importances(spark, m, [f"slot{i}" for i in range(N_HASH)])


@query("permutation_importance", "F5")
def permutation_importance_q(spark, d):
    """Importance of every hashed slot for the rectifier network (accuracy lost when the slot is
    shuffled), all slots in one job."""
    from auger.operators.learners.network import fit_network_averaged
    tr, te = _split(doc_features(spark, d))
    k = len(_lang_levels(spark, d))
    m = fit_network_averaged(tr, N_HASH, k, hidden=(16,), epochs=10, label="lang_idx")
    return S.permutation_importance(spark, m, te, "features", "lang_idx", N_HASH,
                                    [f"slot{i}" for i in range(N_HASH)])


@query("describe_tree", "F6")
def describe_tree_q(spark, d):
    tr, _ = _split(labelled_docs(spark, d))
    return S.describe(spark, B.decision_tree().fit(tr))


@query("score_each_iteration", "F8")
def score_each_iteration_q(spark, d):
    tr, te = _split(labelled_docs(spark, d))
    return S.score_each_iteration(spark, B.gbm().fit(tr), te)


@query("tree_sql", "A11")
def tree_sql_q(spark, d):
    """The boosted ensemble exported as SQL scores the test part; both predictions side by side."""
    from auger.sources.models import score_with_sql
    tr, te = _split(labelled_docs(spark, d))
    m = B.gbm().fit(tr)
    return (score_with_sql(m.transform(te), m)
            .withColumn("p1", vector_to_array("probability")[1])
            .select("doc_id", "prediction", F.col("sql_prediction").alias("prediction_sql"), "p1",
                    F.col("sql_p1").alias("p1_sql")))


@query("model_roundtrip", "A11")
def model_roundtrip_q(spark, d):
    """A 2-tree boosted model saved to the shared folder, loaded back, and scoring the test part."""
    from pyspark.ml import Pipeline
    from auger.session import scratch_path
    from auger.sources.models import load_model, save_model
    tr, te = _split(labelled_docs(spark, d))
    path = save_model(Pipeline(stages=[B.gbm(trees=2)]).fit(tr), scratch_path(spark, "model"))
    return _scored(load_model(path), te)


@query("patterns", "J3")
def patterns_q(spark, d):
    """Leaves of a depth-3 tree as rules: ``(leaf, rule, class, n, support, confidence)``."""
    df = labelled_docs(spark, d)
    names = [f"slot{i}" for i in range(N_HASH)]
    m = B.decision_tree(max_depth=3).fit(df)
    return rule_table(spark, df, m, names, "label")


@query("linear_svc", "H4")
def linear_svc_q(spark, d):
    """Spark's linear SVM (OWL-QN, with intercept) under the original job's budget of 5 iterations."""
    tr, te = _split(labelled_docs(spark, d))
    m = B.linear_svc(max_iter=5).fit(tr)
    return m.transform(te).select("doc_id", "label", "prediction")


@query("train_report", "F7 H10 A8")
def train_report_q(spark, d):
    from auger.plans.train_report import train_and_report
    rep = train_and_report(spark, labelled_docs(spark, d), "GBM", key="doc_id", threshold="max_f1")
    return rep["metrics"]


@query("stream_score", "A6 F1 streaming", sql=NB_SCORED_SQL + "select event_id, prediction from scored")
def stream_score_q(spark, d):
    """The test events arrive as CSV files; a Structured Streaming job cleans, scores (naive
    Bayes fitted on the training part) and appends to parquet; the sink is read back."""
    from auger.session import scratch_path
    from auger.streaming.score_files import score_arrivals
    ev = _event_features(spark, d)
    m = naive_bayes_fit(ev.where(F.col("_b") < 8), _NB_FEATS, "event_type")
    src, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "scored")
    names = ["event_id", *_NB_FEATS]
    ev.where(F.col("_b") >= 8).select(*names).write.csv(src)
    q = score_arrivals(spark, src, names, _NB_FEATS, lambda df: m.transform(df), sink)
    q.awaitTermination()
    return spark.read.parquet(sink).select(F.col("event_id").cast("long"), "prediction")


@query("network_keep_best", "H9")
def network_keep_best_q(spark, d):
    """Network trained in 10-iteration chunks; the chunk with the best validation accuracy wins.
    Validation = the training part's bucket 7 (the test part is never looked at)."""
    from auger.operators.learners.builtin import fit_network_keep_best
    tr, te = _split(doc_features(spark, d))
    fit, valid = tr.where(F.col("_b") < 7), tr.where(F.col("_b") == 7)
    k = len(_lang_levels(spark, d))
    m, _ = fit_network_keep_best(fit, valid, N_HASH, k, hidden=(16,), epochs=30, step=10, label="lang_idx")
    return _scored(m, te, k, label="lang_idx")
