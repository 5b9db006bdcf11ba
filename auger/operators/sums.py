"""Sums of long vectors that many tasks give: in pieces and in two steps, so no reducer sees them all."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8192  # numbers of a vector that travel together


def vector_sums(parts: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """``keys`` and the element-wise sum of the arrays ``values`` of equal length within them.

    Rows of one key are spread over about the root of the number of tasks first, so a reducer takes at
    most that many vectors of a key. Longer vectors travel as pieces, see :func:`piece_rows`."""
    width = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    total = Summarizer.sum(F.col("_v"))
    first = (parts.select(*keys, (F.spark_partition_id() % width).alias("_salt"), array_to_vector(values).alias("_v"))
             .groupBy(*keys, "_salt").agg(total.alias("_v")))
    return first.groupBy(*keys).agg(total.alias("_v")).select(*keys, vector_to_array("_v").alias(values))


PIECES = "piece int, values array<double>"


def piece_rows(vector: np.ndarray, size: int = PIECE):
    """A task's vector as pandas frames of ``PIECES``."""
    for at in range(0, len(vector), size):
        yield pd.DataFrame({"piece": [at // size], "values": [vector[at:at + size]]})


def summed(parts: DataFrame, length: int, size: int = PIECE) -> np.ndarray:
    """The sum over tasks of vectors given as ``PIECES``; zeros where no task gave one."""
    out = np.zeros(length)
    for r in vector_sums(parts, ["piece"]).collect():
        at = r["piece"] * size
        out[at:at + len(r["values"])] = r["values"]
    return out
