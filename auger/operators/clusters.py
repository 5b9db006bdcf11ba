"""Cluster assignment for a scatter chart.

``lloyd``: Lloyd iterations from given starting centres, as plain DataFrame work: the
assignment is one projection (k distance expressions, ``array_min`` of ``(distance, index)``
structs), the update one vector mean per cluster (partial aggregation leaves k rows per task).
Only the k centres travel to the driver.

``cluster``: Spark ML ``KMeans`` (k-means||) and a 2-D ``PCA`` projection for the chart.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auger.session import materialize

MAX_CENTRE_VALUES = 8_000_000


def _sqdist(v: Column, centre: list[float]) -> Column:
    lit = F.array(*[F.lit(float(x)) for x in centre])
    return F.aggregate(F.zip_with(v, lit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)


def assign(df: DataFrame, vec: str, centres: list[list[float]], out: str = "cluster",
           dist_col: str | None = None) -> DataFrame:
    """Nearest centre (lowest index on ties) as ``out``; optionally the distance."""
    v = F.col(vec).cast("array<double>")
    best = F.array_min(F.array(*[F.struct(_sqdist(v, c).alias("d"), F.lit(i).alias("c"))
                                 for i, c in enumerate(centres)]))
    res = df.withColumn("_best", best).withColumn(out, F.col("_best.c"))
    if dist_col:
        res = res.withColumn(dist_col, F.sqrt(F.col("_best.d")))
    return res.drop("_best")


def lloyd(df: DataFrame, vec: str, init: list[list[float]], iterations: int = 5) -> list[list[float]]:
    """Run ``iterations`` update steps; an empty cluster keeps its centre."""
    if len(init) * len(init[0]) > MAX_CENTRE_VALUES:
        raise ValueError("too many centre values to ship to tasks")
    centres = [list(map(float, c)) for c in init]
    base = df.select(F.col(vec).cast("array<double>").alias("_v")).transform(materialize)
    for _ in range(iterations):
        a = assign(base, "_v", centres, "_c")
        means = a.groupBy("_c").agg(Summarizer.mean(array_to_vector("_v")).alias("m")).collect()  # k rows
        new = [list(c) for c in centres]
        for r in means:
            new[r["_c"]] = r["m"].toArray().tolist()
        centres = new
    return centres


def lowest_id_start(df: DataFrame, id_col: str, vec: str, k: int) -> list[list[float]]:
    """Starting centres: the k rows with the lowest ids (a top-k, not a sort of the table)."""
    return [list(map(float, r[0])) for r in df.orderBy(id_col).limit(k).select(vec).collect()]


def cluster(df: DataFrame, id_col: str, vec: str, k: int = 5, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """``(id, cluster, x, y)``: k-means cluster and the first two principal components."""
    fv = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_fv"))
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_fv", predictionCol="cluster").fit(fv)
    pca = PCA(k=2, inputCol="_fv", outputCol="_xy").fit(fv)
    out = pca.transform(km.transform(fv)).withColumn("_a", vector_to_array("_xy"))
    return out.select(id_col, "cluster", F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))
