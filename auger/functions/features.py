"""Tokens, hashed term counts, normalising, scaling, chi-square feature choice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, UnivariateFeatureSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(col: str | Column, sep: str = " ") -> Column:
    """G1: split on a single space, keeping inner empty tokens and dropping trailing ones.

    An empty text gives one empty token; a text of separators only gives none.
    The whole text is tokenised, however long.
    """
    c = F.col(col) if isinstance(col, str) else col
    stripped = F.rtrim(c, F.lit(sep)) if len(sep) == 1 else F.regexp_replace(c, "(" + _re_quote(sep) + ")+$", "")
    parts = F.split(stripped, _re_quote(sep))
    return F.when(c.isNull(), F.lit(None)).when(
        (stripped == "") & (c != ""), F.array().cast("array<string>")).otherwise(parts)


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def hash_tf(df: DataFrame, tokens_col: str = "tokens", num_features: int = 100,
            out: str = "features", binary: bool = False) -> DataFrame:
    """Hashing term frequency (murmur3 slots)."""
    return hashing_tf(tokens_col, num_features, out, binary).transform(df)


def hashing_tf(tokens_col: str = "tokens", num_features: int = 100, out: str = "features",
               binary: bool = False) -> HashingTF:
    return HashingTF(inputCol=tokens_col, outputCol=out, numFeatures=num_features, binary=binary)


def normalize(df: DataFrame, col: str = "features", p: float = float("inf"), out: str = "normed") -> DataFrame:
    """Per-row p-norm normaliser (default L-infinity)."""
    return Normalizer(inputCol=col, outputCol=out, p=p).transform(df)


def standardize(df: DataFrame, col: str = "features", with_mean: bool = False, with_std: bool = True,
                out: str = "scaled"):
    """Fitted scaler (divides by the sample standard deviation). Returns (model, scaled df)."""
    m = StandardScaler(inputCol=col, outputCol=out, withMean=with_mean, withStd=with_std).fit(df)
    return m, m.transform(df)


def chi_square_select(df: DataFrame, features: str = "features", label: str = "label", k: int = 4,
                      out: str = "selected"):
    """Keep the ``k`` features with the strongest chi-square dependence on the label."""
    sel = UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol=out,
                                    selectionMode="numTopFeatures")
    sel.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
    m = sel.fit(df)
    return m, m.transform(df)


def chi_square_scores(df: DataFrame, features: Iterable[str], label: str) -> DataFrame:
    """G6 as plain aggregates: ``(feature, statistic, dof)`` for every categorical feature, one pass.

    Uses chi2 = sum(n_vc^2 / e_vc) - N over observed cells only, e = n_v * n_c / N, so empty
    cells never need to be materialised. Every table below is the size of the feature domains.
    """
    feats = list(features)
    long = df.select(F.col(label).cast("string").alias("_c"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v")) for f in feats
    ])).alias("kv")).select("kv.feature", "kv.v", "_c")
    cells = long.groupBy("feature", "v", "_c").agg(F.count(F.lit(1)).alias("n"))
    # margins and totals by nested sums over the cells; counts as doubles, whose products do not overflow
    cells = cells.withColumn("n", F.col("n").cast("double"))
    by_v = cells.groupBy("feature", "v").agg(F.sum("n").alias("nv"))
    by_c = cells.groupBy("feature", "_c").agg(F.sum("n").alias("nc"))
    levels = (by_v.groupBy("feature").agg(F.sum("nv").alias("n_all"), F.count("v").alias("kv"))
              .join(by_c.groupBy("feature").agg(F.count("_c").alias("kc")), "feature"))
    def with_margin(left: DataFrame, margin: DataFrame, on: str) -> DataFrame:
        other = margin.withColumnsRenamed({"feature": "_f", on: "_k"})  # null is a level of its own
        return left.join(other, (F.col("feature") == F.col("_f")) & F.col(on).eqNullSafe(F.col("_k"))).drop("_f", "_k")

    j = with_margin(with_margin(cells, by_v, "v"), by_c, "_c")
    terms = j.groupBy("feature").agg(F.sum(F.col("n") / F.col("nv") * (F.col("n") / F.col("nc"))).alias("s"))
    return terms.join(levels, "feature").select(
        "feature", (F.col("s") * F.col("n_all") - F.col("n_all")).alias("statistic"),
        ((F.col("kv") - 1) * (F.col("kc") - 1)).cast("long").alias("dof"))
