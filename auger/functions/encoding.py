"""Label and feature encoding with Spark ML stages.

Level order is text order (``alphabetAsc``), so level indexes are the same on every run and
on every machine; indexers are fitted on the training part only and applied to the rest.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.operators.joins import salted_join
from auger.session import materialize, write_scratch


def index_label(train: DataFrame, response: str, out: str = "label",
                handle_invalid: str = "error"):
    """Response -> class index (double). Returns the fitted indexer model."""
    return StringIndexer(inputCol=response, outputCol=out, stringOrderType="alphabetAsc",
                         handleInvalid=handle_invalid).fit(train)


def encode_categorical(cols: Iterable[str], drop_last: bool = False,
                       handle_invalid: str = "keep") -> Pipeline:
    """Categorical features; all levels kept unless ``drop_last``.

    With ``handle_invalid="keep"`` the indexer gives levels unseen in training one extra index,
    which the encoder treats as one more category (a slot that is zero on training rows)."""
    cols = list(cols)
    idx = StringIndexer(inputCols=cols, outputCols=[c + "_lvl" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid=handle_invalid)
    ohe = OneHotEncoder(inputCols=[c + "_lvl" for c in cols], outputCols=[c + "_vec" for c in cols],
                        dropLast=drop_last, handleInvalid="error")
    return Pipeline(stages=[idx, ohe])


def assembler(cols: Iterable[str], out: str = "features", handle_invalid: str = "keep") -> VectorAssembler:
    """The feature vector stage."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def assemble(df: DataFrame, cols: Iterable[str], out: str = "features") -> DataFrame:
    return assembler(cols, out).transform(df)


def domains(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Sorted distinct levels of each column -> ``(column, level, level_index)``.

    The columns are unpivoted into (column, level) pairs and reduced by a partial + final
    distinct aggregate; text-order positions come from :func:`ordered_positions`, so a column
    with very many levels is ranked across many tasks, not in one window.
    """
    cols = list(cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.level")
    distinct = long.where(F.col("level").isNotNull()).distinct()
    return ordered_positions(distinct, "column", "level", "level_index")


BROADCAST_LEVELS = 100_000


@dataclass
class LevelDictionary:
    """Text levels of columns and their places in text order, as a table that Spark joins.

    ``table`` (``column, level, level_index``) is written and never collected, so columns may have any number of
    levels. Up to ``BROADCAST_LEVELS`` levels in all it is broadcast; beyond, it is joined by shuffle with
    frequent levels salted. Levels not in it, and nulls, get null."""

    table: DataFrame
    columns: list[str]
    n_levels: int

    @classmethod
    def fit(cls, df: DataFrame, columns: Iterable[str]) -> "LevelDictionary":
        columns = list(columns)
        table = write_scratch(domains(df, columns), "levels")
        return cls(table, columns, table.count())

    def sizes(self) -> dict[str, int]:
        found = {r[0]: r[1] for r in self.table.groupBy("column").count().collect()}  # one row per column
        return {c: found.get(c, 0) for c in self.columns}

    def transform(self, df: DataFrame, out: dict[str, str]) -> DataFrame:
        """Add the level index of each column named in ``out`` as a column of the name given there."""
        for c, name in out.items():
            level = self.table.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("level_index").alias(name))
            df = df.withColumn("_level", F.col(f"`{c}`").cast("string"))
            if self.n_levels <= BROADCAST_LEVELS:
                df = df.join(F.broadcast(level), "_level", "left").drop("_level")
            else:
                others = [k for k in df.columns if k != "_level"]
                df = salted_join(df, level, "_level", others, "left").drop("_level")
        return df

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "LevelDictionary":
        table = spark.read.parquet(path)
        return cls(table, [r[0] for r in table.select("column").distinct().orderBy("column").collect()], table.count())


def ordered_positions(df: DataFrame, group: str, order: str, out: str = "pos",
                      partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its ``group`` in ``order`` (values unique per group).

    Range partitioning on (group, order) spreads a large group over consecutive partitions;
    rows are numbered inside each (partition, group), and the counts of earlier partitions of the
    same group (a table of groups x partitions) give the offsets. Exact, and no task holds more
    than one range partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    r = df.repartitionByRange(n, group, order).withColumn("_p", F.spark_partition_id())
    r = r.withColumn("_rn", F.row_number().over(Window.partitionBy("_p", group).orderBy(order)))
    r = r.transform(materialize)  # numbered once; read by the counts and by the final join
    counts = r.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (r.join(offs.select(group, "_p", "_off"), [group, "_p"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("int"))
            .drop("_p", "_rn", "_off"))


def fit_pipeline(stages, df: DataFrame) -> PipelineModel:
    return Pipeline(stages=list(stages)).fit(df)
