"""Driver queries for sources, cleaning, encoding, splits and features (A, B, D, E7, E8, G)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from auger.functions import cleaning as C
from auger.functions.encoding import assemble, domains
from auger.functions.features import chi_square_scores, normalize, standardize, tokens
from auger.functions.hashing import hash_bucket_sql
from auger.operators.metrics import class_priors
from auger.operators.splits import folds, sample_split_counts
from auger.plans.catalog import query, table
from auger.session import scratch_path
from auger.sources import arff, tables

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("csv_roundtrip", "A1 A9 B2", sql="""
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer
""")
def csv_roundtrip(spark, d):
    """Customer written as a headerless, CR-ended CSV with padded fields, read back by names."""
    cust = table(spark, d, "customer")
    path = scratch_path(spark, "csv_roundtrip")
    (cust.select(F.col("c_custkey"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("c_name"),
                 "c_nationkey", "c_acctbal", F.concat(F.lit(" "), F.col("c_mktsegment")).alias("c_mktsegment"))
     .write.option("lineSep", "\r").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    back = tables.read_table(spark, path, CUSTOMER_COLS)
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                       F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("arff_roundtrip", "A7", sql="""
select event_id, event_type, value, cast(user_id as double) as user_id from events
""")
def arff_roundtrip(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    levels = [r[0] for r in ev.select("event_type").distinct().orderBy("event_type").limit(100_001).collect()]
    if len(levels) > 100_000:  # a nominal attribute lists its levels in the header
        raise ValueError("too many levels for a nominal ARFF attribute")
    path = scratch_path(spark, "arff_roundtrip")
    arff.write_arff(ev, path, relation="events", nominal={"event_type": levels})
    back = arff.read_arff(spark, path)
    return back.select(F.col("event_id").cast("long"), "event_type", "value", "user_id")


_CLEAN_SQL = """
with raw as (
  select event_id,
         case event_id % 5 when 0 then ' yes ' when 1 then '"NO"' when 2 then ' ? ' when 3 then 'Yes' else 'no' end as f_flag,
         case when event_id % 7 = 0 then 'abc'
              else ' "' || cast(cast(round(value * 100, 0) as bigint) as varchar) || '" ' end as f_num,
         '"' || cast(user_id as varchar) || '"' as f_user
  from events),
c as (
  select event_id,
         replace(trim(f_flag), '"', '') as f_flag,
         replace(trim(f_num), '"', '') as f_num,
         replace(trim(f_user), '"', '') as f_user,
         f_flag is not null as h1, f_num is not null as h2, f_user is not null as h3
  from raw),
e as (
  select event_id,
    case when lower(f_flag) = 'yes' then 1.0 when lower(f_flag) in ('no', '?') then 0.0 else try_cast(f_flag as double) end as f_flag,
    case when lower(f_num) = 'yes' then 1.0 when lower(f_num) in ('no', '?') then 0.0 else try_cast(f_num as double) end as f_num,
    case when lower(f_user) = 'yes' then 1.0 when lower(f_user) in ('no', '?') then 0.0 else try_cast(f_user as double) end as f_user,
    h1, h2, h3
  from c)
select event_id, f_flag, f_num, f_user,
       cast((case when h1 and f_flag is null then 1 else 0 end) + (case when h2 and f_num is null then 1 else 0 end)
            + (case when h3 and f_user is null then 1 else 0 end) as integer) as _bad_fields
from e
"""


@query("clean_encode", "B1 B3 B4 B5 B7", sql=_CLEAN_SQL)
def clean_encode(spark, d):
    """Raw text fields made from events (flags, quoted numbers, a bad field), cleaned and encoded."""
    ev = table(spark, d, "events")
    raw = ev.select(
        "event_id",
        F.expr("case event_id % 5 when 0 then ' yes ' when 1 then '\"NO\"' when 2 then ' ? ' "
               "when 3 then 'Yes' else 'no' end").alias("f_flag"),
        F.expr("case when event_id % 7 = 0 then 'abc' else concat(' \"', "
               "cast(cast(round(value * 100, 0) as bigint) as string), '\" ') end").alias("f_num"),
        F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')).alias("f_user"),
        F.lit("ignored").alias("area"))
    out = C.encode_frame(C.drop_ignored(raw, ["area"]), ["f_flag", "f_num", "f_user"])
    return out.select("event_id", "f_flag", "f_num", "f_user", F.col("_bad_fields").cast("int"))


@query("hash_split_counts", "D2 D1", sql=f"""
select case when {hash_bucket_sql('event_id', 10)} < 8 then 'train' else 'test' end as part,
       count(*) as n_rows
from events group by 1
""")
def hash_split_counts(spark, d):
    return sample_split_counts(table(spark, d, "events"), "event_id", 10, 8)


@query("kfold_counts", "D3", sql=f"""
select cast({hash_bucket_sql('event_id', 10)} as integer) as fold, count(*) as n_rows,
       round(sum(value), 6) as sum_value
from events group by 1
""")
def kfold_counts(spark, d):
    ev = folds(table(spark, d, "events"), "event_id", 10)
    return ev.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 6).alias("sum_value"))


_TOK_SQL = ("case when text <> '' and rtrim(text, ' ') = '' then []::varchar[] "
            "else string_split(rtrim(text, ' '), ' ') end")


@query("union_labelled", "A4 D4 G1", sql=f"""
select doc_id as src_id, 0.0::double as label, cast(len({_TOK_SQL}) as integer) as n_tokens from documents
union all
select item_id, 1.0::double, cast(len({_TOK_SQL}) as integer) from benchmark
""")
def union_labelled(spark, d):
    """One input per class, as the text jobs read one file per class: document texts are class 0,
    benchmark passages class 1; each is scanned once, labelled, and the two are unioned by name."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("src_id"), "text")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("src_id"), "text")
    parts = [p.select("src_id", F.lit(float(i)).alias("label"), F.size(tokens("text")).alias("n_tokens"))
             for i, p in enumerate([docs, bench])]
    return tables.union_all(*parts)


@query("class_priors", "E7", sql="""
select event_type as label, count(*) as n, round(count(*) / sum(count(*)) over (), 10) as prior
from events group by event_type
""")
def class_priors_q(spark, d):
    pr = class_priors(table(spark, d, "events"), "event_type")
    return pr.select("label", "n", F.round("prior", 10).alias("prior"))


@query("domains", "E8 B9", sql="""
with l as (select distinct 'event_type' as "column", event_type as level from events
           union select distinct 'user_id', cast(user_id as varchar) from events)
select "column", level, cast(row_number() over (partition by "column" order by level) - 1 as integer) as level_index
from l
""")
def domains_q(spark, d):
    return domains(table(spark, d, "events"), ["event_type", "user_id"])


_LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("linf_normalize", "G3 B11", sql="""
select l_orderkey, l_linenumber,
  round(l_quantity / m, 8) + 0.0 as n0, round(l_extendedprice / m, 8) + 0.0 as n1,
  round(l_discount / m, 8) + 0.0 as n2, round(l_tax / m, 8) + 0.0 as n3
from (select *, greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount), abs(l_tax)) as m from lineitem)
""")
def linf_normalize(spark, d):
    li = assemble(table(spark, d, "lineitem"), _LI_FEATS)
    nd = normalize(li, "features", float("inf"), "normed")
    return nd.withColumn("_a", vector_to_array("normed")).select(
        "l_orderkey", "l_linenumber", *[(F.round(F.col("_a")[i], 8) + 0.0).alias(f"n{i}") for i in range(4)])


@query("standardize", "G5", sql="""
select l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over (), 6) + 0.0 as z0,
  round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_samp(l_extendedprice) over (), 6) + 0.0 as z1,
  round((l_discount - avg(l_discount) over ()) / stddev_samp(l_discount) over (), 6) + 0.0 as z2,
  round((l_tax - avg(l_tax) over ()) / stddev_samp(l_tax) over (), 6) + 0.0 as z3
from lineitem
""")
def standardize_q(spark, d):
    li = assemble(table(spark, d, "lineitem"), _LI_FEATS)
    _, sc = standardize(li, "features", with_mean=True, with_std=True)
    sc = sc.withColumn("_a", vector_to_array("scaled"))
    return sc.select("l_orderkey", "l_linenumber",
                     *[(F.round(F.col("_a")[i], 6) + 0.0).alias(f"z{i}") for i in range(4)])


@query("scale_std", "G4", sql="""
select l_orderkey, l_linenumber,
  round(l_quantity / stddev_samp(l_quantity) over (), 6) + 0.0 as s0,
  round(l_extendedprice / stddev_samp(l_extendedprice) over (), 6) + 0.0 as s1,
  round(l_discount / stddev_samp(l_discount) over (), 6) + 0.0 as s2,
  round(l_tax / stddev_samp(l_tax) over (), 6) + 0.0 as s3
from lineitem
""")
def scale_std_q(spark, d):
    li = assemble(table(spark, d, "lineitem"), _LI_FEATS)
    _, sc = standardize(li, "features", with_mean=False, with_std=True)
    sc = sc.withColumn("_a", vector_to_array("scaled"))
    return sc.select("l_orderkey", "l_linenumber",
                     *[(F.round(F.col("_a")[i], 6) + 0.0).alias(f"s{i}") for i in range(4)])


@query("discretize", "B13", sql="""
select l_orderkey, l_linenumber, l_quantity / 16 as l_quantity_16, l_extendedprice / 16 as l_extendedprice_16,
       l_discount / 16 + 0.0 as l_discount_16
from lineitem
""")
def discretize_q(spark, d):
    li = table(spark, d, "lineitem")
    out = C.discretize(li, ["l_quantity", "l_extendedprice", "l_discount"], 16.0, suffix="_16")
    return out.select("l_orderkey", "l_linenumber", "l_quantity_16", "l_extendedprice_16",
                      (F.col("l_discount_16") + 0.0).alias("l_discount_16"))


@query("chi_square", "G6", sql="""
with f as (
  select l_linestatus as c, 'l_returnflag' as feature, l_returnflag as v from lineitem
  union all select l_linestatus, 'discount', cast(cast(round(l_discount * 100, 0) as bigint) as varchar) from lineitem
  union all select l_linestatus, 'tax', cast(cast(round(l_tax * 100, 0) as bigint) as varchar) from lineitem
  union all select l_linestatus, 'quantity', cast(cast(l_quantity as bigint) as varchar) from lineitem),
cells as (select feature, v, c, count(*) as n from f group by all),
bv as (select feature, v, sum(n) as nv from cells group by all),
bc as (select feature, c, sum(n) as nc from cells group by all),
t as (select feature, sum(n) as nn, count(distinct v) as kv, count(distinct c) as kc from cells group by all)
select cells.feature, round(sum(n * n * t.nn / (nv * nc)) - max(t.nn), 6) as statistic,
       cast((max(kv) - 1) * (max(kc) - 1) as bigint) as dof
from cells join bv using (feature, v) join bc using (feature, c) join t on cells.feature = t.feature
group by cells.feature
""")
def chi_square_q(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_linestatus", "l_returnflag",
        F.round(F.col("l_discount") * 100, 0).cast("long").cast("string").alias("discount"),
        F.round(F.col("l_tax") * 100, 0).cast("long").cast("string").alias("tax"),
        F.col("l_quantity").cast("long").cast("string").alias("quantity"))
    s = chi_square_scores(li, ["l_returnflag", "discount", "tax", "quantity"], "l_linestatus")
    return s.select("feature", F.round("statistic", 6).alias("statistic"), "dof")


@query("tokens_tf", "G1", sql="""
with t as (select doc_id, text,
  case when text <> '' and rtrim(text, ' ') = '' then []::varchar[] else string_split(rtrim(text, ' '), ' ') end as tok
  from documents)
select doc_id, cast(len(tok) as integer) as n_tokens, cast(len(list_distinct(tok)) as integer) as n_distinct
from t
""")
def tokens_q(spark, d):
    docs = table(spark, d, "documents").withColumn("tok", tokens("text"))
    return docs.select("doc_id", F.size("tok").alias("n_tokens"), F.size(F.array_distinct("tok")).alias("n_distinct"))


@query("format_rows", "A10", sql="""
select concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment) as line from customer
""")
def format_rows_q(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return tables.format_rows(cust)


@query("view_select", "B12 B6", sql="""
select c_custkey, c_name, c_nationkey from customer
""")
def view_select(spark, d):
    v = C.as_view(table(spark, d, "customer"), "auger_customer_view")
    return C.slice_columns(v, 0, 3)


@query("random_split_counts", "D1")
def random_split_counts(spark, d):
    """Seeded 80/20 random split of events: size of each side (random, so no oracle)."""
    from auger.operators.splits import split
    tr, te = split(table(spark, d, "events").select("event_id"), 0.8, seed=42)
    return (tr.select(F.lit("train").alias("part")).unionByName(te.select(F.lit("test").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n_rows")))


@query("chi_square_select", "G6")
def chi_square_select_q(spark, d):
    """Top-4 categorical features of lineitem for the line status (selector over level indexes)."""
    from pyspark.ml.feature import StringIndexer
    from auger.functions.features import chi_square_select
    cols = ["l_returnflag", "discount", "tax", "quantity", "lnum"]
    li = table(spark, d, "lineitem").select(
        "l_linestatus", "l_returnflag",
        F.round(F.col("l_discount") * 100, 0).cast("long").cast("string").alias("discount"),
        F.round(F.col("l_tax") * 100, 0).cast("long").cast("string").alias("tax"),
        F.col("l_quantity").cast("long").cast("string").alias("quantity"),
        F.col("l_linenumber").cast("string").alias("lnum"))
    idx = StringIndexer(inputCols=cols + ["l_linestatus"], outputCols=[c + "_i" for c in cols] + ["label"],
                        stringOrderType="alphabetAsc").fit(li)
    v = assemble(idx.transform(li), [c + "_i" for c in cols])
    m, _ = chi_square_select(v, "features", "label", 4)
    return spark.createDataFrame([(cols[i],) for i in m.selectedFeatures], "feature string")


@query("label_index", "B9 B5", sql="""
with tr as (select distinct event_type from events where """ + hash_bucket_sql("event_id", 10) + """ < 8),
lv as (select event_type, cast(row_number() over (order by event_type) - 1 as double) as label from tr)
select e.event_id, coalesce(lv.label, (select count(*) from lv)::double) as label
from events e left join lv using (event_type)
""")
def label_index_q(spark, d):
    """Response to class index: levels in text order, fitted on the training part, applied to all
    (a level unseen in training gets the next index)."""
    from auger.functions.encoding import index_label
    from auger.functions.hashing import hash_bucket
    ev = table(spark, d, "events").select("event_id", "event_type")
    idx = index_label(ev.where(hash_bucket("event_id", 10) < 8), "event_type", "label", handle_invalid="keep")
    return idx.transform(ev).select("event_id", "label")


@query("csv_header_inferred", "A5 A9", sql="""
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer
""")
def csv_header_inferred(spark, d):
    """Customer written as CSV with a header line (A9) and read back with inferred types (A5);
    the key is widened to 64 bits after inference (small keys infer as int)."""
    cust = table(spark, d, "customer").select(*CUSTOMER_COLS)
    path = scratch_path(spark, "csv_header")
    tables.write_predictions(cust, path)
    back = tables.read_inferred(spark, path)
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                       F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("tsv_positional", "A2 A3 B6", sql="""
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer
""")
def tsv_positional(spark, d):
    """Customer written tab-separated without a header, read back by position (width from the
    first line: c0 ... c4) and named again."""
    cust = table(spark, d, "customer").select(*CUSTOMER_COLS)
    path = scratch_path(spark, "tsv")
    cust.write.option("sep", "\t").csv(path)
    back = tables.read_positional(spark, path, sep="\t")
    return back.select(F.col("c0").cast("long").alias("c_custkey"), F.col("c1").alias("c_name"),
                       F.col("c2").cast("int").alias("c_nationkey"), F.col("c3").cast("double").alias("c_acctbal"),
                       F.col("c4").alias("c_mktsegment"))


@query("labelled_text_files", "A4 D4 G1", sql=f"""
with d as (select dense_rank() over (order by lang) - 1 as label, replace(text, chr(10), ' ') as text from documents)
select cast(label as double) as label, cast(len({_TOK_SQL}) as integer) as n_tokens from d
""")
def labelled_text_files(spark, d):
    """One text file (folder) per class, one document per line - the layout of the original's
    spam / ham files: documents are written per language with line breaks turned into spaces,
    then read back with a label per file and unioned."""
    docs = table(spark, d, "documents").select("lang", F.regexp_replace("text", "\\n", " ").alias("text"))
    levels = [r["level"] for r in domains(docs, ["lang"]).orderBy("level_index").limit(1001).collect()]
    if len(levels) > 1000:
        raise ValueError("too many classes for one file each")
    root = scratch_path(spark, "labelled_text")
    idx = F.create_map(*[x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i))])
    # one scan writes every class's folder (partitioned output), not one scan per class
    docs.select("text", F.element_at(idx, F.col("lang")).alias("cls")).write.partitionBy("cls").text(root)
    back = tables.read_labelled_text(spark, {f"{root}/cls={i}": float(i) for i in range(len(levels))})
    return back.select("label", F.size(tokens("text")).alias("n_tokens"))


@query("json_rows", "A10", sql="""
select '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
       || ',"c_mktsegment":"' || c_mktsegment || '"}' as json
from customer
""")
def json_rows_q(spark, d):
    """A10, JSON form: every row as one JSON object string, built in the tasks."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return tables.rows_as_json(cust)
