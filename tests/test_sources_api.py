"""Readers and sinks by fixture, configured job end to end, registry."""

import os

from pyspark.sql import functions as F

from auger.operators.learners.registry import make, names
from auger.plans.train_report import train_from_config
from auger.sources.config import JobConfig, LabelSpec
from auger.sources.tables import format_rows, read_inferred, read_table, write_predictions


def test_tsv_and_inferred(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.tsv")
    open(p, "w").write('"a"\t"1"\t?\n"b"\t"2"\tyes\n')
    df = read_table(spark, p, ["k", "n", "f"], sep="\t")
    assert [r["n"] for r in df.orderBy("k").collect()] == ["1", "2"]
    h = os.path.join(tmp_dir, "h.csv")
    open(h, "w").write("ID,CAPSULE,PSA\n1,0,1.5\n2,1,2.5\n")
    inf = read_inferred(spark, h)
    assert dict(inf.dtypes) == {"ID": "int", "CAPSULE": "int", "PSA": "double"}


def _churn_like(tmp_dir, n=400):
    p = os.path.join(tmp_dir, "churn.csv")
    with open(p, "w", newline="") as f:
        for i in range(n):
            calls = i % 10
            churn = 1 if calls < 6 else 0
            f.write(f"{churn},{408 + (i % 3)},{'yes' if i % 4 == 0 else 'no'},{(i * 37) % 350 / 1.0},{calls}\r")
    return p


def test_configured_job_end_to_end(spark, tmp_dir):
    p = _churn_like(tmp_dir)
    cfg = JobConfig(path=p, names=("churn", "area", "vmail", "day_mins", "svc_calls"),
                    response=LabelSpec("name", "churn"), ignored=("area",))
    rep = train_from_config(spark, cfg, "decision_tree")
    m = {(r["section"], r["key"]): r["value"] for r in rep["metrics"].collect()}
    assert m[("error", "test_error")] < 0.05  # the label is a rule on svc_calls
    out = os.path.join(tmp_dir, "pred")
    write_predictions(rep["predictions"].select("prediction", "p0", "p1"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["prediction", "p0", "p1"] and back.count() == rep["predictions"].count()
    assert format_rows(back).count() == back.count()


def test_configured_job_with_categorical_column(spark, tmp_dir):
    p = _churn_like(tmp_dir)
    cfg = JobConfig(path=p, names=("churn", "area", "vmail", "day_mins", "svc_calls"),
                    response=LabelSpec("name", "churn"), categorical=("area", "svc_calls"))
    rep = train_from_config(spark, cfg, "decision_tree")
    m = {(r["section"], r["key"]): r["value"] for r in rep["metrics"].collect()}
    assert m[("error", "test_error")] < 0.05  # svc_calls as levels still carries the rule


def test_score_literal_examples_and_registry(spark, tmp_dir):
    from pyspark.ml.linalg import Vectors
    assert {"GLM", "GBM", "DEEP_LEARNING"} <= {n.upper() for n in names()}
    train = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2 * 3.0 + 0.1 * (i % 5), 1.0]))
                                   for i in range(60)], ["label", "features"])
    model = make("naive_bayes").fit(train)
    lit = spark.createDataFrame([(Vectors.dense([3.2, 1.0]),), (Vectors.dense([0.1, 1.0]),)], ["features"])
    from auger.operators.scoring import score
    preds = [r["prediction"] for r in score(model, lit, 2).collect()]
    assert preds == [1.0, 0.0]
    sgd = make("svm_sgd", n_features=2, iterations=20).fit(train)
    assert sgd.transform(lit).where(F.col("prediction").isNotNull()).count() == 2


def test_cli_train_then_score(spark, tmp_dir):
    from auger import cli
    p = _churn_like(tmp_dir)
    conf = os.path.join(tmp_dir, "job.properties")
    open(conf, "w").write("columns=churn,area,vmail,day_mins,svc_calls\nresponse=churn\ncategorical=area\n")
    out = os.path.join(tmp_dir, "run")
    assert cli.main(["train", "--config", conf, "--data", p, "--algorithm", "decision_tree", "--out", out]) == 0
    score_file = os.path.join(tmp_dir, "new.csv")
    open(score_file, "w").write("1,408,no,10.0,1\r0,415,yes,20.0,8\r")
    assert cli.main(["score", "--config", conf, "--data", score_file, "--model", out + "/model",
                     "--out", os.path.join(tmp_dir, "scored")]) == 0
    got = sorted((r["svc_calls"], r["prediction"]) for r in
                 spark.read.option("header", True).csv(os.path.join(tmp_dir, "scored")).collect())
    assert got == [("1.0", "1.0"), ("8.0", "0.0")]
