"""Cleaning and projection as column expressions (JVM-side, codegen'd).

One cleaning path serves both training and scoring input, so the two can never disagree.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auger.sources.config import LabelSpec

# Fixed values of the flag / missing encoder (B4): compared case-blind after cleaning.
TRUE_WORDS = ("yes",)
FALSE_WORDS = ("no",)
MISSING_MARKERS = ("?",)
BAD_FIELDS_COL = "_bad_fields"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_fields(line: str | Column, sep: str = ",") -> Column:
    """B1: one text line into an array of fields (regex-quoted separator)."""
    import re
    return F.split(_c(line), re.escape(sep))


def trim_col(c: str | Column) -> Column:
    """B2."""
    return F.trim(_c(c))


def clean_col(c: str | Column) -> Column:
    """Trim, then delete every double quote."""
    return F.regexp_replace(F.trim(_c(c)), '"', "")


def trim_all(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: trim_col(c) for c in cols})


def clean_all(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: clean_col(c) for c in cols})


def encode_numeric(c: str | Column) -> Column:
    """``yes`` -> 1.0; ``no`` and ``?`` -> 0.0 (case-blind); else the number, or null if unparsable."""
    s = _c(c)
    low = F.lower(s)
    return (F.when(low.isin(*TRUE_WORDS), F.lit(1.0))
            .when(low.isin(*FALSE_WORDS, *MISSING_MARKERS), F.lit(0.0))
            .otherwise(s.try_cast("double")))


def encode_frame(df: DataFrame, cols: Iterable[str], clean: bool = True,
                 bad_col: str = BAD_FIELDS_COL) -> DataFrame:
    """Clean + encode ``cols`` to double, and count unparsable fields per row in ``bad_col``.

    Bad fields never disappear silently: they become null and are counted.
    """
    cols = list(cols)
    enc = {c: encode_numeric(clean_col(c) if clean else F.col(c)) for c in cols}
    bad = F.lit(0)
    for c in cols:
        bad = bad + F.when(F.col(c).isNotNull() & enc[c].isNull(), 1).otherwise(0)
    return df.withColumns({bad_col: bad}).withColumns(enc)


def label_of(df: DataFrame, spec: LabelSpec, out: str = "label") -> DataFrame:
    """Pick the response by spec and cast it to double (cleaned and encoded like features)."""
    name = spec.resolve(df.columns)
    return df.withColumn(out, encode_numeric(clean_col(F.col(name).cast("string"))))


def slice_columns(df: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Keep columns by position, Python slice semantics (``stop`` may be negative)."""
    return df.select(*df.columns[start:stop])


def drop_ignored(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B7."""
    return df.drop(*list(names))


def drop_response(df: DataFrame, response: str) -> DataFrame:
    """B8."""
    return df.drop(response)


def discretize(df: DataFrame, cols: Iterable[str], width: float = 16.0, floor: bool = False,
               suffix: str = "") -> DataFrame:
    """Divide by ``width``; the original does not floor, so flooring is opt-in."""
    def f(c):
        e = F.col(c) / F.lit(float(width))
        return F.floor(e).cast("double") if floor else e
    return df.withColumns({c + suffix: f(c) for c in cols})


def report_table(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Choose columns and title their headers with an upper-case first letter."""
    cols = list(columns) if columns is not None else df.columns
    return df.select(*[F.col(c).alias(c[:1].upper() + c[1:]) for c in cols])


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a temp view and read it back with ``SELECT *``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(f"SELECT * FROM `{name}`")


def wall_clock_hour(df: DataFrame, col: str) -> Column:
    """Hour of day of the stored wall-clock value, whatever the session time zone.

    A ``timestamp_ntz`` column is read as stored; a ``timestamp`` (instant) column is taken in
    UTC (``unix_seconds``), so files written without a zone read the same on every cluster.
    """
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.hour(F.col(col))
    return F.pmod(F.floor(F.unix_seconds(F.col(col)) / 3600), F.lit(24)).cast("int")
