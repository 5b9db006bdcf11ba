"""Running totals over a global order without an un-partitioned window.

A window ``ORDER BY x`` with no ``PARTITION BY`` pulls every row into one task. Here the
ordered keys are cut into range buckets by approximate quantiles (a bounded list of
boundaries), every bucket is summed (one row per bucket), the bucket offsets are prefix-summed
on that small table, and the rows are finished by a window partitioned by bucket. Exact for any
input; no task sees more than one bucket.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.session import shuffle_partitions

MAX_BUCKETS = 4096


def running_totals(df: DataFrame, order_col: str, value_cols: Iterable[str], descending: bool = False,
                   n_buckets: int | None = None, suffix: str = "_run", total_suffix: str = "_total",
                   by: Iterable[str] = ()) -> DataFrame:
    """Add ``<v>_run`` (inclusive running sum in ``order_col`` order) and ``<v>_total`` per value column.

    ``order_col`` must be unique per row (aggregate by it first) and not null; it is compared as double.
    With ``by`` (columns without nulls) the sums run within each group; the buckets are those of all rows.
    """
    vals, by = list(value_cols), list(by)
    spark = df.sparkSession
    nb = n_buckets or min(MAX_BUCKETS, max(8, 4 * shuffle_partitions(spark)))
    key = "_rk"
    keyed = df.withColumn(key, (-F.col(order_col) if descending else F.col(order_col)).cast("double"))
    probs = [i / nb for i in range(1, nb)]
    bounds = sorted(set(keyed.approxQuantile(key, probs, 1.0 / (4 * nb)))) if nb > 1 else []
    bounds = [b for b in bounds if b == b and abs(b) != float("inf")]  # finite boundaries only
    splits = [-float("inf")] + bounds + [float("inf")]
    if len(splits) < 3:  # no boundary (empty or tiny input): a single bucket
        bucketed = keyed.withColumn("_bk", F.lit(0.0))
    else:
        bucketed = Bucketizer(splits=splits, inputCol=key, outputCol="_bk",
                              handleInvalid="keep").transform(keyed)
    # one row per bucket: sizes bounded by the boundary list, so the broadcast is bounded
    per_bucket = bucketed.groupBy(*by, "_bk").agg(*[F.sum(v).alias(f"_b_{v}") for v in vals])
    group = Window.partitionBy(*by).orderBy("_bk")  # one row per bucket
    wall = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wpre = group.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "_bk",
        *[F.coalesce(F.sum(f"_b_{v}").over(wpre), F.lit(0)).alias(f"_o_{v}") for v in vals],
        *[F.sum(f"_b_{v}").over(wall).alias(v + total_suffix) for v in vals])
    wb = Window.partitionBy(*by, "_bk").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the offsets are bounded by the boundary list, unless there are groups: then Spark plans the join
    out = (bucketed.join(offsets if by else F.broadcast(offsets), [*by, "_bk"])
           .withColumns({v + suffix: F.col(f"_o_{v}") + F.sum(v).over(wb) for v in vals}))
    return out.drop("_bk", key, *[f"_o_{v}" for v in vals])
