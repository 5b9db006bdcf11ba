"""Driver queries that run single operators on the inputs that break them: ragged rows, missing scores,
copies among neighbours, marker characters; and direct queries for operators that other queries only use."""

from __future__ import annotations

from pyspark.sql import functions as F

from auger.functions import cleaning as C
from auger.functions.features import hash_tf, tokens
from auger.functions.hashing import hash_bucket_sql
from auger.operators import metrics as M
from auger.operators.neighbours import knn_join, local_outlier_factor
from auger.operators.splits import split
from auger.plans.catalog import query, table
from auger.plans.q_data import _TOK_SQL
from auger.plans.q_metrics import _BASE_SQL, scored_events
from auger.session import materialize, scratch_path
from auger.sources import arff, tables
from auger.sources.config import JobConfig, LabelSpec
from auger.sources.models import load_model, save_model


@query("csv_ragged", "A1 A2 B1", sql="""
select c_custkey, case when c_custkey % 5 = 0 and c_custkey % 7 <> 0 then null else c_name end as c_name,
       case when c_custkey % 5 = 0 or c_custkey % 3 = 1 and c_custkey % 7 <> 0 then null else c_mktsegment end as c_mktsegment,
       cast(case when c_custkey % 7 = 0 then case when c_custkey % 5 = 0 then 0 else 2 end
                 when c_custkey % 5 = 0 then 2 when c_custkey % 3 = 1 then 1 else 0 end as integer) as bad_fields
from customer where c_custkey % 7 <> 0 or c_custkey % 5 <> 0
""")
def csv_ragged(spark, d):
    """Customers as CSV rows with too many fields (every 7th), one (every 5th) or two; nothing is lost unseen."""
    cust = table(spark, d, "customer").where("c_custkey % 7 <> 0 or c_custkey % 5 <> 0")
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    line = (F.when(F.col("c_custkey") % 7 == 0, F.concat_ws(",", key, name, "c_mktsegment", F.lit("more"), F.lit('"a,b"')))
            .when(F.col("c_custkey") % 5 == 0, key).when(F.col("c_custkey") % 3 == 1, F.concat_ws(",", key, name))
            .otherwise(F.concat_ws(",", key, name, "c_mktsegment")))
    path = scratch_path(spark, "csv_ragged")
    cust.select(line.alias("value")).write.text(path)
    back = tables.read_table(spark, path, ["c_custkey", "c_name", "c_mktsegment"], bad_fields="bad_fields")
    return back.select(F.col("c_custkey").cast("long"), "c_name", "c_mktsegment", F.col("bad_fields").cast("int"))


_RAGGED_NAMES = ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"]


def _ragged_customers(spark, d) -> str:
    """Customers as CSV rows: every 7th with two fields more, else every 5th with two less, else every 11th with
    a balance that is no number."""
    key, rest = F.col("c_custkey"), F.concat_ws(",", F.col("c_nationkey").cast("string"), "c_mktsegment")
    bal = F.when((key % 11 == 0) & (key % 5 != 0) & (key % 7 != 0), F.lit("none known")).otherwise(F.col("c_acctbal").cast("string"))
    line = (F.when(key % 7 == 0, F.concat_ws(",", key.cast("string"), bal, rest, F.lit("more"), F.lit('"a,b"')))
            .when(key % 5 == 0, F.concat_ws(",", key.cast("string"), bal))
            .otherwise(F.concat_ws(",", key.cast("string"), bal, rest)))
    path = scratch_path(spark, "ragged")
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return path


@query("ragged_jobs", "A8 A6 F7 streaming", sql="""
with r as (
  select case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 2 when c_custkey % 11 = 0 then 1 else 0 end as bad from customer),
s as (select cast(count(*) as bigint) as n, cast(count(*) filter (where bad > 0) as bigint) as bad_rows, cast(sum(bad) as bigint) as bad_fields from r)
select job, n as "rows", bad_rows, bad_fields from s, (values ('scoring'), ('stream'), ('training')) as j(job)
""")
def ragged_jobs(spark, d):
    """Ragged rows are counted by the scoring set's reader, by the stream and by the configured training job."""
    from auger.plans.train_report import train_from_config
    from auger.streaming.score_files import score_arrivals
    path, sink = _ragged_customers(spark, d), scratch_path(spark, "ragged-scored")
    cfg = JobConfig(path=path, names=tuple(_RAGGED_NAMES), response=LabelSpec("name", "c_mktsegment"), key="c_custkey")
    counts = lambda df, job: df.agg(
        F.lit(job).alias("job"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_bad_fields") > 0).alias("bad_rows"),
        F.sum("_bad_fields").cast("long").alias("bad_fields"))
    scoring = counts(tables.read_scoring(spark, path, cfg), "scoring")
    score_arrivals(spark, path, _RAGGED_NAMES, ["c_acctbal", "c_nationkey"], lambda df: df, sink).awaitTermination()
    rep = train_from_config(spark, cfg, "DECISION_TREE")
    return (scoring.unionByName(counts(spark.read.parquet(sink), "stream"))
            .unionByName(rep["input"].select(F.lit("training").alias("job"), "rows", "bad_rows", "bad_fields")))


@query("arff_markers", "A7", sql="""
select event_id, case cast(event_id % 6 as integer) when 0 then '@handle' when 1 then '%odd' when 2 then 'it''s' when 3 then '@data'
                 when 4 then 'a, b' else event_type end as mark from events
""")
def arff_markers(spark, d):
    """Values that look like ARFF markers, written and read back."""
    ev = table(spark, d, "events")
    mark = F.expr("case cast(event_id % 6 as int) when 0 then '@handle' when 1 then '%odd' when 2 then \"it's\" "
                  "when 3 then '@data' when 4 then 'a, b' else event_type end")
    path = scratch_path(spark, "arff_markers")
    arff.write_arff(ev.select("event_id", mark.alias("mark")), path, relation="marks")
    return arff.read_arff(spark, path).select(F.col("event_id").cast("long"), "mark")


_UNSCORED = "event_id % 10 = 3"
_SOME_SQL = _BASE_SQL.replace("from events)", f"from events where not ({_UNSCORED}))")


def _some_scored(spark, d):
    return scored_events(spark, d).withColumn("p", F.when(~F.expr(_UNSCORED), F.col("p")))


@query("auc_unscored", "E5", sql=_SOME_SQL + f"""
, r as (select p, count(*) as cnt, sum(label) as pos from s group by p),
c as (select p, cnt, pos, sum(cnt) over (order by p) - cnt as below from r),
t as (select sum(pos) as np, sum(cnt) - sum(pos) as nn from r)
select round((sum(pos * (below + (cnt + 1) / 2.0)) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 10) as auc,
       (select count(*) from events where {_UNSCORED}) as n_unscored
from c, t
""")
def auc_unscored(spark, d):
    """A tenth of the rows has no score: they are counted, and leave the ranking of the others alone."""
    s = _some_scored(spark, d)
    return M.auc(s, "p", "label").select(F.round("auc", 10).alias("auc")).withColumn(
        "n_unscored", M.unscored(s, "p").select("n_unscored").scalar())


@query("sweep_unscored", "E6", sql=_SOME_SQL + """
, r as (select p, count(*) as cnt, sum(label) as pos from s group by p),
c as (select p, sum(cnt) over (order by p desc) as pp, sum(pos) over (order by p desc) as tp from r),
t as (select sum(pos) as np, sum(cnt) as tot from r)
select p as thr, cast(tp as bigint) as tp, cast(pp - tp as bigint) as fp, cast(np - tp as bigint) as fn,
       cast(tot - np - (pp - tp) as bigint) as tn from c, t
""")
def sweep_unscored(spark, d):
    sw = M.threshold_sweep(_some_scored(spark, d), "p", "label")
    return sw.select("thr", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


@query("lof_with_copies", "J1", sql="""
with e0 as (select vec_id, cast(embedding as double[]) as v from embeddings),
e as (select * from e0 union all select 1000000 + vec_id * 100 + c, v from e0, range(12) r(c) where vec_id < 2),
pairs as (select a.vec_id as i, b.vec_id as j, list_distance(a.v, b.v) as d from e a join e b on a.vec_id <> b.vec_id),
k as (select i, j, d from (select *, row_number() over (partition by i order by d, j) as r from pairs) x where r <= 10),
kd as (select i, max(d) as kd from k group by i),
mean as (select k.i, avg(greatest(k.d, kd.kd)) as m from k join kd on k.j = kd.i group by k.i),
f as (select k.i, max(a.m) as own, count(*) filter (where b.m = 0) as dense, avg(case when b.m > 0 then 1 / b.m end) as near
      from k join mean a on k.i = a.i join mean b on k.j = b.i group by k.i)
select i as vec_id, case when own = 0 then 1.0 when dense > 0 then 'infinity'::double else round(near * own, 6) end as lof from f
""")
def lof_with_copies(spark, d):
    """Two embeddings have twelve copies each: copies are inliers, and what has a copy as a neighbour without
    being one stands out without limit."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    copies = emb.where("vec_id < 2").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(11)))).select(
        (F.lit(1_000_000) + F.col("vec_id") * 100 + F.col("c")).alias("vec_id"), "embedding")
    lof = local_outlier_factor(knn_join(emb.unionByName(copies), "vec_id", "embedding", 10))
    return lof.select(F.col("i").alias("vec_id"), F.round("lof", 6).alias("lof"))


@query("label_of", "B5", sql="""
select event_id, case when event_id % 3 = 0 then 1.0 when event_id % 3 = 1 then 0.0 else value end::double as label from events
""")
def label_of_q(spark, d):
    """The response by position, cleaned and encoded: flags with quotes and blanks, and numbers."""
    raw = table(spark, d, "events").select("event_id", F.expr(
        "case when event_id % 3 = 0 then ' \"Yes\" ' when event_id % 3 = 1 then 'NO' else cast(value as string) end").alias("response"))
    return C.label_of(raw, LabelSpec("last")).select("event_id", "label")


@query("drop_response", "B8 B7", sql="select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def drop_response_q(spark, d):
    return C.drop_ignored(C.drop_response(table(spark, d, "orders"), "o_orderstatus"), ["o_orderdate"])


@query("split_fields", "B1", sql="select c_custkey, len(string_split(c_name || '|' || c_mktsegment || '||', '|')) as n, c_mktsegment as second from customer")
def split_fields_q(spark, d):
    """Lines with a separator that is special in patterns; empty fields at the end count."""
    line = F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("||"))
    parts = table(spark, d, "customer").select("c_custkey", C.split_fields(line, "|").alias("f"))
    return parts.select("c_custkey", F.size("f").cast("long").alias("n"), F.col("f")[1].alias("second"))


@query("mse_operator", "E2", sql=_BASE_SQL + """
select round(sum((label - prediction) * (label - prediction)) / count(*), 10) as mse,
       round(sum((label - prediction) * (label - prediction)), 6) as sse, count(*) as n_rows from s
""")
def mse_operator(spark, d):
    return M.mse(scored_events(spark, d)).select(F.round("mse", 10).alias("mse"), F.round("sse", 6).alias("sse"), "n_rows")


@query("hashed_counts", "G2", sql=f"""
select doc_id, cast(len({_TOK_SQL}) as bigint) as n_tokens from documents
""")
def hashed_counts(spark, d):
    """The hashed term counts of a text sum up to its tokens."""
    from pyspark.ml.functions import vector_to_array
    docs = table(spark, d, "documents").select("doc_id", tokens("text").alias("tokens"))
    total = F.aggregate(vector_to_array(F.col("features")), F.lit(0.0), lambda a, x: a + x)
    return hash_tf(docs, "tokens", 100).select("doc_id", total.cast("long").alias("n_tokens"))


@query("random_split_whole", "D1", sql="select count(*) as n_rows, 0 as n_both, true as train_is_larger from events")
def random_split_whole(spark, d):
    """The two sides of a random split hold every row once."""
    a, b = split(table(spark, d, "events").select("event_id"), 0.8, 42)
    sides = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(0)))
    both = sides.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("train"))
    return both.agg(F.sum("n").alias("n_rows"), F.count(F.when(F.col("n") > 1, 1)).cast("int").alias("n_both"),
                    (F.sum("train") > F.count(F.lit(1)) / 2).alias("train_is_larger"))


@query("config_tables", "A8 A6 B7 B11", sql="""
select c_custkey, c_acctbal, c_nationkey::double as c_nationkey, cast(0 as integer) as _bad_fields from customer
""")
def config_tables(spark, d):
    """A scoring set described by job properties: read, response and ignored columns off, cleaned and encoded."""
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    path = scratch_path(spark, "config_tables")
    table(spark, d, "customer").select(*cols).write.csv(path)
    cfg = JobConfig.from_properties(f"columns={','.join(cols)}\nignored=c_name\nresponse=c_mktsegment\nkey=c_custkey\nheader=false\n", path)
    out = tables.read_scoring(spark, cfg.path, cfg)
    return out.select(F.col("c_custkey").cast("long"), "c_acctbal", "c_nationkey", F.col("_bad_fields").cast("int"))


# ---------------------------------------------------------------- learners: what must hold exactly

_TEST_DOCS = f"{hash_bucket_sql('doc_id', 10)} >= 8"


def _events_xy(spark, d):
    """Events as a two-class table: purchase or not, by value and hour."""
    from auger.functions.encoding import assemble
    ev = table(spark, d, "events")
    rows = ev.select("event_id", "event_type", (F.col("value") / 100).alias("x0"), (C.wall_clock_hour(ev, "ts") / 24).alias("x1"),
                     F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"))
    return assemble(rows, ["x0", "x1"])


def _disagree(a, b, key: str):
    """``n, n_mismatch``: rows that two scorings share, and those they score differently."""
    pair = a.select(key, F.col("prediction").alias("p")).join(b.select(key, F.col("prediction").alias("q")), key)
    return pair.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("p").eqNullSafe(F.col("q")), 1)).alias("n_mismatch"))


@query("saved_pipeline", "A11", sql=f"select count(*) as n, 0::bigint as n_mismatch from documents join labels using (doc_id) where {_TEST_DOCS}")
def saved_pipeline(spark, d):
    """A boosted pipeline scores the test part the same before it is saved and after it is loaded."""
    from pyspark.ml import Pipeline
    from auger.operators.learners import builtin
    from auger.plans.q_learners import _split, labelled_docs
    tr, te = _split(labelled_docs(spark, d))
    m = Pipeline(stages=[builtin.gbm(trees=2)]).fit(tr)
    return _disagree(m.transform(te), load_model(save_model(m, scratch_path(spark, "saved-pipeline"))).transform(te), "doc_id")


@query("saved_models", "A11 H3 H5", sql="""
select unnest(['glm', 'logistic_sgd', 'naive_bayes']) as model, count(*) as n, 0::bigint as n_mismatch from events
""")
def saved_models(spark, d):
    """This package's own models, saved, loaded and compared on every event."""
    from auger.operators.learners.bayes import naive_bayes_fit
    from auger.operators.learners.registry import make
    xy = _events_xy(spark, d).transform(materialize)
    models = {"glm": make("GLM").fit(xy), "logistic_sgd": make("logistic_sgd", n_features=2).fit(xy),
              "naive_bayes": naive_bayes_fit(xy, ["x0", "x1"], "event_type")}
    parts = [_disagree(m.transform(xy), load_model(save_model(m, scratch_path(spark, "saved-models"))).transform(xy), "event_id")
             .select(F.lit(name).alias("model"), "n", "n_mismatch") for name, m in models.items()]
    return tables.union_all(*parts)


@query("tree_as_sql", "A11", sql=f"select count(*) as n, 0::bigint as n_mismatch from documents join labels using (doc_id) where {_TEST_DOCS}")
def tree_as_sql(spark, d):
    """The SQL text of a boosted ensemble predicts what the ensemble predicts."""
    from auger.operators.learners import builtin
    from auger.plans.q_learners import _split, labelled_docs
    from auger.sources.models import score_with_sql
    tr, te = _split(labelled_docs(spark, d))
    m = builtin.gbm(trees=3).fit(tr)
    out = score_with_sql(m.transform(te), m)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prediction") != F.col("sql_prediction"), 1)).alias("n_mismatch"))


@query("boost_start", "H7 H8", sql="""
with c as (select event_type, count(*) as n from events group by 1),
p as (select event_type, cast(row_number() over (order by event_type) - 1 as integer) as k, n / sum(n) over () as p from c),
m as (select avg(ln(p)) as m from p)
select k, round(ln(p) - m, 8) as start_value, round((select -sum(p * ln(p)) from p), 8) as first_loss from p, m
""")
def boost_start(spark, d):
    """One round over the five event types: the start values and the loss before the first tree."""
    from auger.functions.encoding import index_label
    from auger.operators.learners.boosting import fit_boosting
    xy = _events_xy(spark, d).drop("label")
    m = fit_boosting(index_label(xy, "event_type", "label").transform(xy), rounds=1, depth=1)
    rows = [(k, round(v, 8), round(m.history[0], 8)) for k, v in enumerate(m.init)]
    return spark.createDataFrame(rows, "k int, start_value double, first_loss double")


@query("boost_start_two", "H7", sql="""
with c as (select avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as p1 from events)
select round(0.5 * ln((1 - p1) / p1), 8) as start_value, round(-(p1 * ln(p1) + (1 - p1) * ln(1 - p1)), 8) as first_loss from c
""")
def boost_start_two(spark, d):
    from auger.operators.learners.boosting import fit_boosting
    m = fit_boosting(_events_xy(spark, d), rounds=1, depth=1)
    return spark.createDataFrame([(round(m.init[0], 8), round(m.history[0], 8))], "start_value double, first_loss double")


@query("glm_optimum", "H5", sql="select count(*) as n, 0.0::double as score0, 0.0::double as score1, 0.0::double as score2 from events")
def glm_optimum(spark, d):
    """Without a penalty the fitted model solves the score equations: residuals sum to zero against 1 and each input."""
    from auger.operators.learners.glm import fit_glm
    xy = _events_xy(spark, d).transform(materialize)
    m = fit_glm(xy, "features", "label", 0.0, 0.0, False, 50, 1e-9)
    r = m.transform(xy).withColumn("r", F.col("label") - F.col("p1"))
    zero = lambda e, name: (F.abs(F.round(F.sum(e), 4))).alias(name)
    return r.agg(F.count(F.lit(1)).alias("n"), zero(F.col("r"), "score0"), zero(F.col("r") * F.col("x0"), "score1"),
                 zero(F.col("r") * F.col("x1"), "score2"))


@query("network_forward", "H9 F1", sql="""
with x as (select event_id, value / 100 as a, hour(ts) / 24 as b from events),
h as (select event_id, greatest(0.5 * a - 1.0 * b + 0.1, 0) as h0, greatest(-0.25 * a + 2.0 * b - 0.2, 0) as h1 from x),
z as (select event_id, 1.0 * h0 - 0.5 * h1 as z0, -0.75 * h0 + 0.5 * h1 + 0.05 as z1 from h)
select event_id, round(exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 8) as p1,
       case when z1 > z0 then 1.0 else 0.0 end::double as prediction from z
""")
def network_forward(spark, d):
    """A network of two inputs, two rectifier units and two classes with given weights."""
    import numpy as np
    from auger.operators.learners.network import AveragedNetwork
    theta = np.array([0.5, -0.25, -1.0, 2.0, 0.1, -0.2, 1.0, -0.75, -0.5, 0.5, 0.0, 0.05])
    out = AveragedNetwork([2, 2, 2], theta).transform(_events_xy(spark, d).select("event_id", "features"))
    return out.select("event_id", F.round("p1", 8).alias("p1"), "prediction")


@query("tree_stump", "H1 F4", sql="""
with f as (
  select value > 55 as y, 'x0' as feature, floor(value / 20) as v from events
  union all select value > 55, 'x1', cast(hour(ts) as double) from events),
s as (select l.feature, l.v as t, count(*) as nl, sum(r.y::int) as pl from (select distinct feature, v from f) l
      join f r on r.feature = l.feature and r.v <= l.v group by 1, 2),
a as (select count(*) as n, sum(y::int) as p from f where feature = 'x0'),
g as (select feature, t, nl, n, 2.0 * (pl * (nl - pl) / nl::double + (p - pl) * (n - nl - (p - pl)) / (n - nl)::double) / n as gini
      from s, a where nl < n)
select feature, cast(nl as bigint) as n_left, 1.0::double as importance from g order by gini, feature, t limit 1
""")
def tree_stump(spark, d):
    """A tree of one split: the feature with all the importance, and the rows left of its threshold."""
    from auger.functions.encoding import assemble
    from auger.operators.learners import builtin
    from auger.operators.scoring import importances
    ev = table(spark, d, "events")
    rows = ev.select(F.floor(F.col("value") / 20).cast("double").alias("x0"), C.wall_clock_hour(ev, "ts").cast("double").alias("x1"),
                     F.when(F.col("value") > 55, 1.0).otherwise(0.0).alias("label"))
    xy = assemble(rows, ["x0", "x1"]).transform(materialize)
    m = builtin.decision_tree(max_depth=1, max_bins=64).fit(xy)
    m.setLeafCol("leaf")
    top = importances(spark, m, ["x0", "x1"]).where("importance > 0")
    left = m.transform(xy).agg(F.count(F.when(F.col("leaf") == 0, 1)).alias("n_left"))
    return top.withColumn("n_left", left.scalar()).select("feature", "n_left", "importance")


@query("config_report", "F7 H10 A8 H2", sql=f"""
with t as (select event_id, case when event_type = 'purchase' then 1.0 else 0.0 end as y, value, hour(ts) as h from events),
tr as (select * from t where {hash_bucket_sql('event_id', 10)} < 8), te as (select * from t where {hash_bucket_sql('event_id', 10)} >= 8),
w0 as (select 0.0::double as a, 0.0::double as b),
w1 as (select max(a) - 1.0 * sum((1.0 / (1.0 + exp(-(value * a + h * b))) - y) * value) / count(*) as a,
              max(b) - 1.0 * sum((1.0 / (1.0 + exp(-(value * a + h * b))) - y) * h) / count(*) as b from tr, w0),
s as (select y, case when 1.0 / (1.0 + exp(-(value * a + h * b))) > 0.5 then 1.0 else 0.0 end as p from te, w1)
select 'error' as section, 'accuracy' as key, round(avg(case when y = p then 1.0 else 0.0 end), 10) as value from s
union all select 'error', 'n_rows', count(*)::double from s
""")
def config_report(spark, d):
    """The configured job end to end: a CSV with named columns, a learner by name, the report's numbers."""
    from auger.plans.train_report import train_from_config
    ev = table(spark, d, "events")
    path = scratch_path(spark, "config_report")
    ev.select("event_id", F.when(F.col("event_type") == "purchase", "yes").otherwise("no").alias("y"), "value",
              C.wall_clock_hour(ev, "ts").alias("h")).write.csv(path)
    cfg = JobConfig.from_properties("columns=event_id,y,value,h\nresponse=y\nignored=event_id\nkey=event_id\npositive_label=yes", path)
    rep = train_from_config(spark, cfg, "logistic_sgd", iterations=1)
    return (rep["metrics"].where("section = 'error' and key in ('accuracy', 'n_rows')")
            .select("section", "key", F.round("value", 10).alias("value")))


@query("naive_bayes_many", "H2", sql="""
with t as (select event_id, user_id, value, cast(hour(ts) as double) as h from events),
c as (select user_id, count(*) as n_c, sum(value) as s0, sum(h) as s1 from t group by 1),
tot as (select sum(n_c) as n, count(*) as kk from c),
m as (select user_id, ln(n_c + 1.0) - ln(n + kk) as lp, ln(s0 + 1.0) - ln(s0 + s1 + 2.0) as t0, ln(s1 + 1.0) - ln(s0 + s1 + 2.0) as t1 from c, tot)
select event_id, arg_max(m.user_id, lp + value * t0 + h * t1) as prediction from t, m group by event_id
""")
def naive_bayes_many(spark, d):
    """A model of as many classes as there are users, applied to every event."""
    from auger.operators.learners.bayes import naive_bayes_fit
    ev = table(spark, d, "events")
    rows = ev.select("event_id", "user_id", "value", C.wall_clock_hour(ev, "ts").cast("double").alias("h"))
    return naive_bayes_fit(rows, ["value", "h"], "user_id").transform(rows).select("event_id", "prediction")
