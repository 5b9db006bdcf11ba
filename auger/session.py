"""Session helpers: one place for configuration and for the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "auger",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one configured for tests and the bench.

    On a cluster the session already exists (spark-submit), and this returns it unchanged.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint directory).
    Only when neither is set and the master is local (tests) a fresh folder under the system temp
    dir is made; on a cluster a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="auger-ckpt-")
    sc.setCheckpointDir(conf)
    d = sc.getCheckpointDir() or conf
    return d.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage (reliable checkpoint:
    survives lost executors). The folder comes from the session; see :func:`checkpoint_dir`."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/auger-scratch/{name}-{uuid.uuid4().hex[:12]}"


def write_scratch(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but compressed, with column pruning and filter
    pushdown for the readers. The files go when the driver's JVM ends (see :func:`drop_scratch`
    for an earlier end)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files behind a :func:`write_scratch` table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    root = next(iter(df.inputFiles()), "").partition("/auger-scratch/")
    if root[1]:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root[0]}/auger-scratch/{root[2].split('/')[0]}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
