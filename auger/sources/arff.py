"""ARFF tables, read and written as Spark text jobs.

The header (``@relation``, ``@attribute``, ``@data``) is tiny and is the only part brought to
the driver; the body is parsed in parallel with ``from_csv`` under the schema the header gives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTR = r"(?i)^\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*?)\s*$"


def _arff_type(spec: str) -> T.DataType:
    s = spec.strip().lower()
    if s in ("numeric", "real", "integer"):
        return T.DoubleType()
    return T.StringType()  # nominal {…}, string, date: kept as text


def _first_file(spark: SparkSession, path: str) -> str:
    """The file an ARFF header lives in: ``path`` itself, or the first visible part by name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return path
    names = sorted(st.getPath().toString() for st in fs.listStatus(p)
                   if st.isFile() and not st.getPath().getName().startswith(("_", ".")))
    if not names:
        raise ValueError(f"no data files in {path}")
    return names[0]


def _head_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of the first file up to and with ``@data``; ``take`` reads from the file's start and
    only as far as needed."""
    text, n = spark.read.text(_first_file(spark, path)), 1024
    while True:
        lines = [r[0] for r in text.take(n)]  # the header: one line per attribute and comment
        for i, line in enumerate(lines):
            if re.match(r"(?i)\s*@data\b", line):
                return lines[:i + 1]
        if len(lines) < n:
            raise ValueError(f"no @data line in {path}")
        n *= 8


def read_arff_header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Attribute (name, type spec) pairs in declaration order; only the head of the first file is read."""
    found = [re.match(_ATTR, line) for line in _head_lines(spark, path)]
    return [(m[1].strip("'\""), m[2]) for m in found if m]


def _body_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines after ``@data`` of the first file and all lines of the others, but comments and blank
    lines. A data line may start with ``@``: the header is cut off by its number of lines."""
    n = len(_head_lines(spark, path))
    first = _first_file(spark, path)
    place = ["value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    own = spark.read.text(first).select(*place)
    begin = own.where(F.col("_start") == 0).agg(F.min("_at")).first()[0]  # lines of one split have numbers in a row
    body = own.where((F.col("_start") != 0) | (F.col("_at") >= begin + n)).select("value")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rest = spark.read.text(path).where(name != F.lit(first.rsplit("/", 1)[-1])).select("value") if first != path else None
    return (body if rest is None else body.unionAll(rest)).where(~F.col("value").rlike(r"^\s*(%|$)"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Parse an ARFF file (or folder of parts): numeric attributes -> double, nominal -> string.

    ``?`` is ARFF's missing value and becomes null.
    """
    attrs = read_arff_header(spark, path)
    if not attrs:
        raise ValueError(f"no @attribute lines in {path}")
    schema = T.StructType([T.StructField(n, _arff_type(t), True) for n, t in attrs])
    body = (_body_lines(spark, path)
            .select(F.from_csv(F.col("value"), ", ".join(f"`{n}` STRING" for n, _ in attrs),
                               {"quote": "'", "ignoreLeadingWhiteSpace": "true",
                                "ignoreTrailingWhiteSpace": "true"}).alias("r"))
            .select("r.*"))
    return body.select(*[
        F.when(F.col(f.name) == "?", F.lit(None)).otherwise(
            F.col(f.name).try_cast(f.dataType) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        ).cast(f.dataType).alias(f.name) for f in schema])


def _arff_spec(field: T.StructField, levels: list[str] | None) -> str:
    if levels is not None:
        return "{" + ",".join(levels) + "}"
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    return "string"


def write_arff(df: DataFrame, path: str, relation: str = "data",
               nominal: dict[str, list[str]] | None = None) -> str:
    """Write ``df`` as an ARFF folder: the header is its own small part, the body is written in
    parallel, one part per partition. ``nominal`` gives level lists for nominal attributes."""
    nominal = nominal or {}
    spark = df.sparkSession
    header = [f"@relation {relation}", ""]
    for f in df.schema:
        name = f.name if re.fullmatch(r"[A-Za-z_][\w.-]*", f.name) else f"'{f.name}'"
        header.append(f"@attribute {name} {_arff_spec(f, nominal.get(f.name))}")
    header += ["", "@data"]
    head_df = spark.createDataFrame([(h,) for h in header], "value string").coalesce(1)

    def fmt(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType):
            s = c.cast("string")
        else:
            s = F.when(F.col(f.name).rlike(r"[,\s'%{}@\"?]|^$"),
                       F.concat(F.lit("'"), F.regexp_replace(c.cast("string"), "'", "\\\\'"), F.lit("'"))
                       ).otherwise(c.cast("string"))
        return F.coalesce(s, F.lit("?"))

    body = df.select(F.concat_ws(",", *[fmt(f) for f in df.schema]).alias("value"))
    head_df.unionByName(body).write.mode("overwrite").text(path)
    return path
