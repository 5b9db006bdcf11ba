"""Rule tables, picked rows as JSON, search and sort of a report table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auger.functions.cleaning import report_table  # noqa: F401  (B14/B15, re-exported)


def select_rows(df: DataFrame, picks: DataFrame, key: str, json_col: str = "json") -> DataFrame:
    """Rows whose ``key`` occurs in ``picks`` (a left-semi join: no duplicates, no pick
    columns), with the row as JSON next to its key."""
    chosen = df.join(picks.select(key), key, "left_semi")
    return chosen.select(F.col(key), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(json_col))


def search_rows(df: DataFrame, term: str, columns: Iterable[str] | None = None,
                order_by: str | None = None, descending: bool = True) -> DataFrame:
    """Case-blind text search over the shown columns, then the table's sort."""
    cols = list(columns) if columns is not None else df.columns
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))
    out = df.where(hay.contains(term.lower()))
    if order_by:
        out = out.orderBy(F.col(order_by).desc() if descending else F.col(order_by).asc())
    return out


def rule_table(spark: SparkSession, df: DataFrame, tree_model, names: list[str], label: str = "label",
               features: str = "features") -> DataFrame:
    """The leaves of a fitted tree as rules: ``(leaf, rule, class, n, support, confidence)``.

    Rows are tagged with their leaf by the tree's own SQL text (no model object in the tasks),
    counted per (leaf, class) with a partial aggregate; the result has one row per leaf.
    """
    from auger.sources.models import tree_rules
    rules, leaf_sql, _ = tree_rules(spark, tree_model, names)
    tagged = (df.withColumn("_features_arr", vector_to_array(F.col(features)))
              .withColumn("leaf", F.expr(leaf_sql)))
    per = tagged.groupBy("leaf", F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n_c"))
    leaf = per.groupBy("leaf").agg(F.sum("n_c").alias("n"), F.max_by("_y", "n_c").alias("class"),
                                   F.max("n_c").alias("n_major"))
    rule_map = F.create_map(*[x for k, v in sorted(rules.items()) for x in (F.lit(k), F.lit(v))])
    wall = Window.partitionBy()  # one row per leaf: at most 2^depth rows
    return leaf.select("leaf", F.element_at(rule_map, F.col("leaf")).alias("rule"), "class", "n",
                       (F.col("n") / F.sum("n").over(wall)).alias("support"),
                       (F.col("n_major") / F.col("n")).alias("confidence"))


def pattern_rules(df: DataFrame, items: list[str], label: str, min_support: float = 0.05, min_confidence: float = 0.0,
                  max_items: int = 3) -> DataFrame:
    """Frequent value combinations as rules for the class: ``antecedent`` (sorted ``column=value`` items),
    ``class, n, support`` (of both together), ``confidence, lift``.

    FP-growth over one item per column and the class. Nulls are no items. Rules of over ``max_items`` items and
    those for another column than the class are left out; the least support also bounds the sets kept."""
    from pyspark.ml.fpm import FPGrowth
    item = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")))
    baskets = df.select(F.array_compact(F.array(*[item(c) for c in [*items, label]])).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("antecedent") <= max_items) & F.startswith(F.col("consequent")[0], F.lit(f"{label}=")))
    total = baskets.agg(F.count(F.lit(1))).scalar()
    return rules.select(F.array_sort("antecedent").alias("antecedent"),
                        F.substring(F.col("consequent")[0], len(label) + 2, 1 << 30).alias("class"),
                        F.round(F.col("support") * total).cast("long").alias("n"), "support", "confidence", "lift")
