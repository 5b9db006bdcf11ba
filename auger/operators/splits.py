"""Random and repeatable splits, folds, union, caching."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.functions.hashing import hash_bucket
from auger.sources.tables import union_all  # noqa: F401  (D4 lives with the readers)


def split(df: DataFrame, train_fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Seeded random split (the original had no seed)."""
    a, b = df.randomSplit([train_fraction, 1.0 - train_fraction], seed=seed)
    return a, b


def with_bucket(df: DataFrame, key: str, buckets: int = 10, out: str = "_bucket") -> DataFrame:
    return df.withColumn(out, hash_bucket(key, buckets))


def hash_split(df: DataFrame, key: str, buckets: int = 10, train: int = 8) -> tuple[DataFrame, DataFrame]:
    """Repeatable split: rows whose key hashes below ``train`` of ``buckets`` go to training.

    No shuffle: both sides are filters over the same scan.
    """
    b = hash_bucket(key, buckets)
    return df.where(b < train), df.where(b >= train)


def folds(df: DataFrame, key: str, k: int = 10, out: str = "fold") -> DataFrame:
    """D3: fold column for k-fold cross-validation (usable as ``CrossValidator.foldCol``)."""
    return df.withColumn(out, hash_bucket(key, k))


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep an iterative learner's input cached for the loop, then release it.

    A lost executor only loses cached blocks, which Spark recomputes from the lineage.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def sample_split_counts(df: DataFrame, key: str, buckets: int = 10, train: int = 8) -> DataFrame:
    """Size of each side of :func:`hash_split` in one aggregate."""
    b = hash_bucket(key, buckets)
    return (df.groupBy(F.when(b < train, F.lit("train")).otherwise(F.lit("test")).alias("part"))
            .agg(F.count(F.lit(1)).alias("n_rows")))
