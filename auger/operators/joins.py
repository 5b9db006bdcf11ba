"""A skew-safe equi-join for a big side and a side with few rows per key.

Used where results computed per group are attached back to the group's rows (kNN copy groups,
LOF's neighbour densities): a key that holds a third of the big side would otherwise put that
third into one task. Hot keys are found by a partial + final count (two extra passes: the total and
the per-key counts); there are fewer than ``max_hot_keys`` of them by construction (threshold =
total / max_hot_keys), so their list is collected and broadcast with a proven bound. A hot key's big-side rows are spread over
``ceil(count / threshold)`` salts by a hash of ``salt_cols``; its small-side rows are copied once
per salt. Other keys join as usual.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_HOT_ROWS = 100_000
MAX_HOT_KEYS = 10_000


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_cols: Sequence[str],
                how: str = "inner", min_hot_rows: int | None = None,
                max_hot_keys: int | None = None) -> DataFrame:
    """``big JOIN small USING (key)`` with hot keys of ``big`` salted."""
    min_hot_rows = MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows
    max_hot_keys = MAX_HOT_KEYS if max_hot_keys is None else max_hot_keys
    total = big.count()
    thr = max(min_hot_rows, math.ceil(total / max_hot_keys))
    hot_rows = (big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > thr)
                .select(key, F.ceil(F.col("_n") / F.lit(thr)).cast("int").alias("_s")).collect())
    if not hot_rows:  # fewer than max_hot_keys rows by construction: total / thr bounds them
        return big.join(small, key, how)
    schema = big.select(key).schema.add("_s", T.IntegerType())
    hot = F.broadcast(big.sparkSession.createDataFrame(hot_rows, schema))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.coalesce(F.col("_s"), F.lit(1))).cast("int")
    big_s = big.join(hot, key, "left").withColumn("_salt", salt).drop("_s")
    small_s = (small.join(hot, key, "left")
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_s"), F.lit(1)) - 1)))
               .drop("_s"))
    return big_s.join(small_s, [key, "_salt"], how).drop("_salt")
