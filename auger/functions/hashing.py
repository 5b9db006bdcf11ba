"""Repeatable row hashing used by splits and folds.

``bucket = int(first 8 hex digits of md5(str(key)), 16) % n``: identical in Spark SQL and in
DuckDB (``('0x'||substr(md5(cast(key as varchar)),1,8))::BIGINT % n``), independent of
partitioning, file order and executor count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: str | Column, buckets: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(int(buckets))).cast("int")


def hash_bucket_sql(key: str, buckets: int) -> str:
    """The DuckDB text of :func:`hash_bucket`."""
    return f"(('0x'||substr(md5(cast({key} as varchar)),1,8))::BIGINT % {int(buckets)})"
