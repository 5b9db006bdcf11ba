"""Driver queries of the histogram booster, and the same trees grown by SQL over the plain rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from auger.functions.hashing import hash_bucket, hash_bucket_sql
from auger.operators.learners.histogram_trees import fit_histogram_boosting
from auger.plans.catalog import query, table

BINS, MIN_ROWS = 20, 5
VALID_SQL = f"{hash_bucket_sql('event_id', 10)} >= 8"


def boosting_sql(label: str, classes: int, rounds: int, depth: int, rate: float) -> str:
    """CTEs that boost ``events`` on ``value`` (equal-width bins) and ``user_id`` (level sets): ``split_i_l`` and
    ``leaf_i`` of each round, ``loss_i`` before it (and after the last)."""
    trees = 1 if classes == 2 else classes
    ctes = [f"""ev as (select event_id as id, {label} as y, {VALID_SQL} as valid, value, user_id::varchar as u from events)""",
            """lv as (select u, dense_rank() over (order by u) - 1 as code from (select distinct u from ev where not valid))""",
            f"""rg as (select min(value) as lo, (max(value) - min(value)) / {BINS} as wd from ev where not valid)""",
            f"""base as (select id, y, valid, cast(least(greatest(floor((value - lo) / wd), 0), {BINS - 1}) as integer) as b0,
                 cast(coalesce(code, -1) as integer) as b1 from ev left join lv using (u), rg)""",
            f"""prior as (select c as k, (select count(*) from base where not valid and y = c) / (select count(*) from base where not valid) as p
                 from range({classes}) t(c))""",
            (f"""s0 as (select base.*, 0 as k, (select 0.5 * ln(max(p) filter (where k = 0) / max(p) filter (where k = 1)) from prior) as f from base)"""
             if classes == 2 else
             """s0 as (select base.*, k, ln(p) - (select avg(ln(p)) from prior) as f from base, prior)""")]
    for i in range(rounds + 1):
        source, p = f"s{i}", "1 / (1 + exp(-2 * f))"
        if classes > 2:
            source, p = f"(select *, max(f) over (partition by id) as m from s{i})", "exp(f - m) / sum(exp(f - m)) over (partition by id)"
        ctes.append(f"""n_{i}_0 as (select *, (y = k)::integer - p as r, abs((y = k)::integer - p) * (1 - abs((y = k)::integer - p)) as w, 0 as node
                        from (select *, {p} as p from {source}))""")
        true = "case when y = 0 then p else 1 - p end" if classes == 2 else "p"
        which = "true" if classes == 2 else "y = k"
        ctes.append(f"""loss_{i} as (select {i} as iteration, avg(-ln(greatest({true}, 1e-15))) filter (where not valid) as train_loss,
                        avg(-ln(greatest({true}, 1e-15))) filter (where valid) as valid_loss from n_{i}_0 where {which})""")
        if i == rounds:
            break
        for d in range(depth):
            at, first = f"{i}_{d}", 2 ** d - 1
            ctes += [
                f"""h_{at} as (select k, node, f, b, count(*) as n, sum(r) as s, sum(w) as w from (
                      select k, node, 0 as f, b0 as b, r, w from n_{at} where not valid and node >= {first}
                      union all select k, node, 1, b1, r, w from n_{at} where not valid and node >= {first}) group by all)""",
                f"""c_{at} as (select *, row_number() over o as pos, sum(n) over (o rows unbounded preceding) as ln, sum(s) over (o rows unbounded preceding) as ls,
                      sum(n) over e as tn, sum(s) over e as ts from h_{at}
                      window e as (partition by k, node, f), o as (partition by k, node, f order by case when f = 0 then b else round(s / n, 9) end, b))""",
                f"""cut_{at} as (select *, round(ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn, 6) as gain from c_{at}
                      where ln >= {MIN_ROWS} and tn - ln >= {MIN_ROWS})""",
                f"""split_{at} as (select * from cut_{at} where gain > 0
                      qualify row_number() over (partition by k, node order by gain desc, f, pos) = 1)""",
                f"""left_{at} as (select c.k, c.node, c.f, c.b from c_{at} c join split_{at} s using (k, node, f) where c.pos <= s.pos)""",
                f"""n_{i}_{d + 1} as (select n.* exclude (node), case when s.k is null then n.node
                      when s.f = 0 and n.b0 <= s.b or s.f = 1 and l.b is not null then 2 * n.node + 1 else 2 * n.node + 2 end as node
                      from n_{at} n left join split_{at} s on s.k = n.k and s.node = n.node
                      left join left_{at} l on l.k = n.k and l.node = n.node and l.f = 1 and l.b = n.b1)"""]
        ctes += [f"""leaf_{i} as (select k, node, count(*) as n, {classes - 1} / {classes} * sum(r) / sum(w) as value
                       from n_{i}_{depth} where not valid group by k, node)""",
                 f"""s{i + 1} as (select n.id, n.y, n.valid, n.b0, n.b1, n.k, n.f + {rate} * coalesce(leaf.value, 0) as f
                       from n_{i}_{depth} n left join leaf_{i} leaf on leaf.k = n.k and leaf.node = n.node)"""]
    return "with " + ",\n".join(c.replace(" as (", " as materialized (", 1) for c in ctes)


def splits_sql(label: str, classes: int, rounds: int, depth: int, rate: float) -> str:
    parts = [f"""select {i} as round, k as tree, node, case f when 0 then 'value' else 'user_id' end as feature, case when f = 0 then b end as cut,
                 case when f = 1 then pos end as n_levels, gain, tn as n, null as value from split_{i}_{d}""" for i in range(rounds) for d in range(depth)]
    parts += [f"select {i}, k, node, null, null, null, null, n, value from leaf_{i}" for i in range(rounds)]
    return (boosting_sql(label, classes, rounds, depth, rate) + "\nselect round::integer as round, tree::integer as tree, node::integer as node, feature, "
            "cut::integer as cut, n_levels::integer as n_levels, gain, n::bigint as n, round(value, 8) as value from (" + "\nunion all ".join(parts) + ")")


def history_sql(label: str, classes: int, rounds: int, depth: int, rate: float) -> str:
    parts = [f"select iteration, train_loss, valid_loss from loss_{i}" for i in range(rounds + 1)]
    return (boosting_sql(label, classes, rounds, depth, rate) + "\nselect iteration::integer as iteration, round(train_loss, 8) as train_loss, "
            "round(valid_loss, 8) as valid_loss from (" + "\nunion all ".join(parts) + ")")


PURCHASE = "(event_type = 'purchase')::integer"
TYPE = "case event_type when 'click' then 0 when 'purchase' then 1 when 'view' then 2 else 3 end"


def _fit(spark, d, label, **settings):
    ev = table(spark, d, "events").select(
        "event_id", "value", F.col("user_id").cast("string").alias("user_id"), label.alias("label"),
        (hash_bucket("event_id", 10) >= 8).alias("valid"))
    return fit_histogram_boosting(ev, ["value"], ["user_id"], valid="valid", bins=BINS, min_rows=MIN_ROWS, **settings)


def _purchase():
    return (F.col("event_type") == "purchase").cast("int")


def _type():
    t = F.col("event_type")
    return F.when(t == "click", 0).when(t == "purchase", 1).when(t == "view", 2).otherwise(3)


@query("boost_splits", "H7 B10", sql=splits_sql(PURCHASE, 2, 1, 2, 0.5))
def boost_splits(spark, d):
    """Cuts, level sets over all users and leaf values of one boosting round of depth 2, two classes."""
    m = _fit(spark, d, _purchase(), rounds=1, depth=2, rate=0.5)
    return m.splits(spark).withColumn("value", F.round("value", 8))


@query("boost_splits_multiclass", "H8 H7", sql=splits_sql(TYPE, 4, 2, 2, 0.3))
def boost_splits_multiclass(spark, d):
    """Two rounds of depth 2 with a tree for each of four classes."""
    m = _fit(spark, d, _type(), rounds=2, depth=2, rate=0.3, n_classes=4)
    return m.splits(spark).withColumn("value", F.round("value", 8))


@query("boost_history", "F8 H8", sql=history_sql(TYPE, 4, 2, 1, 0.3))
def boost_history(spark, d):
    """Training and validation loss before and after each of two rounds."""
    h = _fit(spark, d, _type(), rounds=2, depth=1, rate=0.3, n_classes=4).history(spark)
    return h.select("iteration", F.round("train_loss", 8).alias("train_loss"), F.round("valid_loss", 8).alias("valid_loss"))
