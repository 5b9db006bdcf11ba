"""The driver's query catalogue: every registered query with its DuckDB oracle text.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or data Spark derives
from them). Queries without an exact SQL form (trained models) register no oracle; the driver
then checks row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}
_IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` names the SURVEY operator IDs it covers."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        _IDS[name] = ids
        if sql is not None:
            _ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _load() -> None:
    from auger.plans import q_boosting, q_checks, q_data, q_learners, q_metrics, q_models, q_reports  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def operator_ids() -> dict[str, str]:
    _load()
    return dict(_IDS)
