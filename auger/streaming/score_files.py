"""Scoring of files that arrive in a folder (the upload-then-score path, A6 + F1) as a
Structured Streaming job.

New delimited files in ``source_dir`` are read with the configured string schema, cleaned and
encoded by the same expressions as the training data, scored by a fitted model (any object
with ``transform``, e.g. a ``PipelineModel`` or the aggregate naive Bayes model) and appended to
a parquet sink. The stream's progress lives in a checkpoint under the session's shared
checkpoint folder, so a restarted job neither loses nor repeats a file. The scoring is a
stateless projection: no watermark or state store is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from auger.functions.cleaning import encode_frame
from auger.session import scratch_path
from auger.sources.tables import RAGGED, add_ragged, count_bad_fields, csv_options


def read_arrivals(spark: SparkSession, source_dir: str, names: Iterable[str], sep: str = ",",
                  max_files_per_trigger: int | None = None, bad_fields: str | None = None) -> DataFrame:
    """The stream of rows; ``bad_fields`` counts the fields missing or left over in each, as in a batch."""
    names = list(names)
    r = csv_options(spark.readStream, names, sep, keep_raw=bad_fields is not None)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.csv(source_dir)
    return count_bad_fields(df, len(names), sep, bad_fields) if bad_fields else df


def score_arrivals(spark: SparkSession, source_dir: str, names: Iterable[str], features: Iterable[str],
                   score: Callable[[DataFrame], DataFrame], sink_path: str, sep: str = ",",
                   checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream; with ``once`` it processes what is there now and stops. ``score`` is given the
    cleaned rows with ``_bad_fields``: what each row lost, ragged rows included."""
    stream = read_arrivals(spark, source_dir, names, sep, bad_fields=RAGGED)
    scored = score(add_ragged(encode_frame(stream, list(features))))
    w = (scored.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start()
