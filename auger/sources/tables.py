"""Delimited and text sources, CSV and line sinks.

Every reader returns a lazy DataFrame; schemas are given up front wherever the caller knows
them, so no extra pass over the data is spent on inference.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auger.functions.cleaning import BAD_FIELDS_COL, clean_col, encode_frame
from auger.sources.config import JobConfig


_RAW, RAGGED = "_corrupt_record", "_ragged"


def string_schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_table(spark: SparkSession, path: str, names: Iterable[str], sep: str = ",",
               trim: bool = True, header: bool = False, line_sep: str | None = None,
               bad_fields: str | None = None) -> DataFrame:
    """A1/A3: headerless delimited file with configured column names (all strings).

    Any of CR, LF and CRLF ends a line unless ``line_sep`` pins one. A row with too few fields gets
    nulls, one with too many keeps its first ones; ``bad_fields`` names a column that counts the fields
    missing or left over in each row (0 for a sound one), so that neither goes unseen.
    """
    names = list(names)
    r = csv_options(spark.read.option("header", header), names, sep, trim, bad_fields is not None)
    if line_sep:
        r = r.option("lineSep", line_sep)
    df = r.csv(path)
    return count_bad_fields(df, len(names), sep, bad_fields) if bad_fields else df


def csv_options(reader, names: Iterable[str], sep: str = ",", trim: bool = True, keep_raw: bool = False):
    """A batch or streaming reader set up for string columns; ``keep_raw`` keeps the text of ragged rows."""
    schema = string_schema(names)
    if keep_raw:
        reader = reader.option("columnNameOfCorruptRecord", _RAW).option("columnPruning", False)
        schema = schema.add(_RAW, T.StringType())
    return (reader.schema(schema).option("sep", sep).option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim))


def count_bad_fields(df: DataFrame, width: int, sep: str, out: str) -> DataFrame:
    """The fields missing or left over in each row, from the kept text of ragged rows (0 elsewhere)."""
    bare = F.regexp_replace(_RAW, r'"([^"\\]|\\.|"")*"', "")  # separators inside quotes part no fields
    n_fields = F.size(F.split(bare, re.escape(sep), -1))
    return df.withColumn(out, F.coalesce(F.abs(n_fields - width), F.lit(0))).drop(_RAW)


def read_positional(spark: SparkSession, path: str, n_columns: int | None = None, sep: str = ",",
                    prefix: str = "c", bad_fields: str | None = None) -> DataFrame:
    """A2: headerless CSV whose columns are known only by position: ``c0 … c{n-1}``.

    Without ``n_columns`` the width is that of the first row as the CSV parser sees it; longer and
    shorter rows are counted in ``bad_fields`` (see :func:`read_table`).
    """
    if n_columns is None:
        n_columns = len(spark.read.option("sep", sep).csv(path).columns)  # reads the first row only
        if not n_columns:
            raise ValueError(f"{path} is empty")
    return read_table(spark, path, [f"{prefix}{i}" for i in range(n_columns)], sep=sep, bad_fields=bad_fields)


def read_labelled_text(spark: SparkSession, sources: Mapping[str, float],
                       text_col: str = "text", label_col: str = "label") -> DataFrame:
    """A4: one document per line, one file (or folder) per class; union of all classes."""
    parts = [spark.read.text(p).withColumnRenamed("value", text_col)
             .withColumn(label_col, F.lit(float(v))) for p, v in sources.items()]
    return union_all(*parts)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def read_inferred(spark: SparkSession, path: str, sep: str = ",", sampling_ratio: float = 1.0) -> DataFrame:
    """A5: file with a header line; types inferred (costs one pass; lower ``sampling_ratio`` at scale)."""
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("samplingRatio", sampling_ratio).option("sep", sep).csv(path))


def read_config_table(spark: SparkSession, cfg: JobConfig, bad_fields: str | None = None) -> DataFrame:
    """A1 driven by A8; ``bad_fields`` as in :func:`read_table`. Names come from the settings, from the header
    line, or by position."""
    if cfg.header or not cfg.names:
        names = spark.read.option("header", cfg.header).option("sep", cfg.sep).csv(cfg.path).columns
        return read_table(spark, cfg.path, names, sep=cfg.sep, trim=False, header=cfg.header, bad_fields=bad_fields)
    return read_table(spark, cfg.path, cfg.names, sep=cfg.sep, bad_fields=bad_fields)


def read_scoring(spark: SparkSession, path: str, cfg: JobConfig, drop_label: bool = True) -> DataFrame:
    """An unlabelled (or label-dropped) scoring set, cleaned exactly like the training set.

    ``_bad_fields`` counts what each row lost: fields that are no number, and those missing or left over."""
    df = read_table(spark, path, cfg.names, sep=cfg.sep, bad_fields=RAGGED)
    resp = cfg.response.resolve(list(cfg.names))
    if drop_label:
        df = df.drop(resp)
    feats = [c for c in df.columns if c not in cfg.ignored and c not in cfg.categorical and c not in (resp, RAGGED)]
    cats = [c for c in cfg.categorical if c in df.columns]
    return add_ragged(encode_frame(df.withColumns({c: clean_col(c) for c in cats}), feats))


def add_ragged(df: DataFrame) -> DataFrame:
    """Add the fields that ragged rows miss or have left over to ``_bad_fields``."""
    return df.withColumn(BAD_FIELDS_COL, F.col(BAD_FIELDS_COL) + F.col(RAGGED)).drop(RAGGED)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Predictions as CSV with a header line (one file per partition, written in parallel)."""
    flat = df.select(*[F.col(f.name).cast("string") if not isinstance(
        f.dataType, (T.StringType, T.NumericType, T.BooleanType)) else F.col(f.name) for f in df.schema])
    flat.write.mode(mode).option("header", True).csv(path)
    return path


def format_rows(df: DataFrame, sep: str = ",", out: str = "line") -> DataFrame:
    """A10: every row as one text line (``concat_ws``); stays distributed, nothing is collected."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                      for c in df.columns]).alias(out))


def rows_as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """A10 (JSON form): every row as a JSON object string."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(out))

