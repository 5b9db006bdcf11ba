"""Every registered query with an oracle equals its DuckDB text on the small driver tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(rel.columns, drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["label", "prediction", "n"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_is_documented_and_tagged():
    import os
    from auger.plans.catalog import operator_ids, queries
    readme = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    ids = operator_ids()
    for name in E.queries():
        assert f"`{name}`" in readme, name
    for name in queries():
        assert ids[name].strip(), name
