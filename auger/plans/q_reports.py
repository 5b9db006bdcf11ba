"""Driver queries for the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auger.functions.cleaning import report_table
from auger.operators.clusters import assign, cluster, lloyd, lowest_id_start
from auger.operators.neighbours import knn_join, local_outlier_factor, top_outliers
from auger.operators.reports import search_rows, select_rows
from auger.plans.catalog import query, table

K_NN = 10
K_MEANS, LLOYD_ITERS = 5, 5

_PAIRS_SQL = """
with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
pairs as (select a.vec_id as i, b.vec_id as j, list_distance(a.v, b.v) as d from e a join e b on a.vec_id <> b.vec_id),
k as (select i, j, d, r from (select *, row_number() over (partition by i order by d, j) as r from pairs) x where r <= 10)
"""

_LOF_SQL = _PAIRS_SQL + """,
kd as (select i, max(d) as kd from k group by i),
lrd as (select k.i, 1 / avg(greatest(k.d, kd.kd)) as lrd from k join kd on k.j = kd.i group by k.i),
lof as (select k.i, avg(l2.lrd) / max(l1.lrd) as lof from k join lrd l1 on k.i = l1.i join lrd l2 on k.j = l2.i group by k.i)
"""


@query("knn", "J1", sql=_PAIRS_SQL + "select i, j, round(d, 6) as d, cast(r as integer) as rank from k")
def knn_q(spark, d):
    """Exact 10 nearest neighbours of every embedding (pivot-pruned, no pair list)."""
    nn = knn_join(table(spark, d, "embeddings"), "vec_id", "embedding", K_NN)
    return nn.select("i", "j", F.round("d", 6).alias("d"), "rank")


@query("lof_scores", "J1", sql=_LOF_SQL + "select i as vec_id, round(lof, 6) as lof from lof")
def lof_scores_q(spark, d):
    lof = local_outlier_factor(knn_join(table(spark, d, "embeddings"), "vec_id", "embedding", K_NN))
    return lof.select(F.col("i").alias("vec_id"), F.round("lof", 6).alias("lof"))


@query("top_outliers", "J1 B15", sql=_LOF_SQL + "select i as vec_id, round(lof, 6) as lof from lof order by lof desc, i limit 5")
def top_outliers_q(spark, d):
    t = top_outliers(table(spark, d, "embeddings"), "vec_id", "embedding", K_NN, 5)
    return t.select("vec_id", F.round("lof", 6).alias("lof"))


def _lloyd_sql(k: int, iters: int, final: str) -> str:
    ctes = ["e as (select vec_id, cast(embedding as double[]) as v from embeddings)",
            f"c0 as (select cast(row_number() over (order by vec_id) - 1 as integer) as cl, v from "
            f"(select * from e order by vec_id limit {k}))"]
    for it in range(1, iters + 1):
        p = f"c{it - 1}"
        ctes.append(f"a{it} as (select vec_id, v, cl from (select e.vec_id, e.v, {p}.cl, row_number() over "
                    f"(partition by e.vec_id order by list_distance(e.v, {p}.v), {p}.cl) as rn from e, {p}) x where rn = 1)")
        ctes.append(f"u{it} as (select cl, pos, avg(x) as m from (select cl, unnest(v) as x, "
                    f"generate_subscripts(v, 1) as pos from a{it}) y group by cl, pos)")
        ctes.append(f"n{it} as (select cl, list(m order by pos) as v from u{it} group by cl)")
        ctes.append(f"c{it} as (select cl, v from n{it} union all select cl, v from {p} "
                    f"where cl not in (select cl from n{it}))")
    last = f"c{iters}"
    if final == "assign":
        body = (f"select vec_id, cl as cluster from (select e.vec_id, {last}.cl, row_number() over "
                f"(partition by e.vec_id order by list_distance(e.v, {last}.v), {last}.cl) as rn from e, {last}) x "
                f"where rn = 1")
    else:
        body = (f"select cl as cluster, cast(pos - 1 as integer) as pos, round(x, 6) as value from "
                f"(select cl, unnest(v) as x, generate_subscripts(v, 1) as pos from {last}) z")
    return "with " + ",\n".join(ctes) + "\n" + body


@query("lloyd", "J2", sql=_lloyd_sql(K_MEANS, LLOYD_ITERS, "assign"))
def lloyd_q(spark, d):
    emb = table(spark, d, "embeddings")
    centres = lloyd(emb, "embedding", lowest_id_start(emb, "vec_id", "embedding", K_MEANS), LLOYD_ITERS)
    return assign(emb, "embedding", centres, "cluster").select("vec_id", "cluster")


@query("lloyd_centres", "J2", sql=_lloyd_sql(K_MEANS, LLOYD_ITERS, "centres"))
def lloyd_centres_q(spark, d):
    emb = table(spark, d, "embeddings")
    centres = lloyd(emb, "embedding", lowest_id_start(emb, "vec_id", "embedding", K_MEANS), LLOYD_ITERS)
    rows = [(c, p, float(round(v, 6))) for c, cen in enumerate(centres) for p, v in enumerate(cen)]
    return spark.createDataFrame(rows, "cluster int, pos int, value double")


@query("cluster", "J2")
def cluster_q(spark, d):
    return cluster(table(spark, d, "embeddings"), "vec_id", "embedding", K_MEANS)


@query("report_table", "B14", sql="""
select c_custkey as "C_custkey", c_name as "C_name", c_mktsegment as "C_mktsegment", c_acctbal as "C_acctbal"
from customer
""")
def report_table_q(spark, d):
    return report_table(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


@query("report_drop_last", "B15", sql="""
select c_custkey as "C_custkey", c_name as "C_name", c_nationkey as "C_nationkey", c_acctbal as "C_acctbal" from customer
""")
def report_drop_last_q(spark, d):
    cust = table(spark, d, "customer")
    return report_table(cust, cust.columns[:-1])


@query("select_rows", "J5", sql="""
select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' as json
from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 400000)
""")
def select_rows_q(spark, d):
    """Customers picked for follow-up (those with a large urgent order), as JSON rows."""
    picks = (table(spark, d, "orders")
             .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
             .select(F.col("o_custkey").alias("c_custkey")))
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return select_rows(cust, picks, "c_custkey")


@query("search_rows", "J6", sql="""
select c_custkey, c_name, c_mktsegment, c_acctbal from customer
where contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_mktsegment)), 'build')
""")
def search_rows_q(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    hits = search_rows(cust, "build", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], order_by="c_acctbal")
    return hits.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def _prediction_table_sql() -> str:
    from auger.plans.q_learners import NB_SCORED_SQL
    return NB_SCORED_SQL + 'select event_id as "Event_id", prediction as "Prediction" from scored'


@query("prediction_table", "J4 B14", sql=_prediction_table_sql())
def prediction_table_q(spark, d):
    from auger.plans.q_learners import naive_bayes_score_q
    return report_table(naive_bayes_score_q(spark, d))


@query("outlier_patterns", "J3 J1")
def outlier_patterns_q(spark, d):
    """Rules that describe the outliers: every embedding is labelled by whether its local outlier
    factor is in the top tenth, and a depth-3 tree over the 64 coordinates gives the rule table."""
    from pyspark.ml.functions import array_to_vector
    from auger.operators.learners.builtin import decision_tree
    from auger.operators.reports import rule_table
    from auger.session import materialize
    emb = table(spark, d, "embeddings")
    lof = local_outlier_factor(knn_join(emb, "vec_id", "embedding", K_NN)).transform(materialize)
    cut = lof.approxQuantile("lof", [0.9], 1e-4)[0]
    data = (emb.join(lof.withColumnRenamed("i", "vec_id"), "vec_id")
            .select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                    F.when(F.col("lof") >= cut, 1.0).otherwise(0.0).alias("label")))
    m = decision_tree(max_depth=3).fit(data)
    width = m.numFeatures
    return rule_table(spark, data, m, [f"e{i}" for i in range(width)], "label")
