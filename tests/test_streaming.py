"""Arriving CSV files are cleaned like training data, scored and appended to parquet."""

import os

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from auger.functions.encoding import assembler
from auger.operators.learners.registry import make
from auger.streaming.score_files import score_arrivals


def test_stream_scores_arrivals_once(spark, tmp_dir):
    train = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2) * 4 + 0.5, 1.0])) for i in range(40)],
                                  ["label", "features"])
    model = make("decision_tree").fit(train)
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    open(os.path.join(src, "a.csv"), "w").write('1,"4.5",yes\n2, 0.5 ,YES\n')
    open(os.path.join(src, "b.csv"), "w").write("3,?,no\n")
    feats = ["x", "flag"]
    asm = assembler(feats)
    sink = os.path.join(tmp_dir, "out")
    q = score_arrivals(spark, src, ["id", "x", "flag"], feats,
                       lambda df: model.transform(asm.transform(df)).select("id", "x", "prediction"),
                       sink, checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    got = {r["id"]: (r["x"], r["prediction"]) for r in spark.read.parquet(sink).collect()}
    assert got == {"1": (4.5, 1.0), "2": (0.5, 0.0), "3": (0.0, 0.0)}
    # a restart with the same checkpoint sees no new file and writes nothing twice
    q2 = score_arrivals(spark, src, ["id", "x", "flag"], feats,
                        lambda df: model.transform(asm.transform(df)).select("id", "x", "prediction"),
                        sink, checkpoint=os.path.join(tmp_dir, "ck"))
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == 3
    assert spark.read.parquet(sink).where(F.col("prediction").isNull()).count() == 0


def test_stream_counts_bad_fields(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in2")
    os.makedirs(src)
    open(os.path.join(src, "a.csv"), "w").write('1,"4.5",yes\n2,abc,no\n')
    sink = os.path.join(tmp_dir, "out2")
    q = score_arrivals(spark, src, ["id", "x", "flag"], ["x", "flag"],
                       lambda df: df.select("id", "x", "flag", "_bad_fields"), sink,
                       checkpoint=os.path.join(tmp_dir, "ck2"))
    q.awaitTermination()
    got = {r["id"]: (r["x"], r["flag"], r["_bad_fields"]) for r in spark.read.parquet(sink).collect()}
    assert got == {"1": (4.5, 1.0, 0), "2": (None, 0.0, 1)}
