import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from auger.functions.encoding import assemble
from auger.operators.learners import bayes, builtin
from auger.operators.learners.histogram_trees import fit_histogram_boosting
from auger.operators.learners.network import AveragedNetwork, weight_importances
from auger.operators.learners.registry import make
from auger.operators.scoring import describe
from auger.operators.sums import PIECES, piece_rows, summed
from auger.sources.model_json import model_json
from auger.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                   F.concat(F.lit("u"), F.col("id") % 40).alias("u"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    return assemble(rows, ["a", "b"]).cache()


MODELS = {"decision_tree": {}, "gbm": {"trees": 2}, "glm": {}, "linear_svc": {}, "gbm_newton": {"rounds": 2, "depth": 2},
          "logistic_sgd": {"n_features": 2}, "deep_learning": {"n_in": 2, "n_classes": 2, "hidden": (3,), "epochs": 1}}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_every_kind_of_model_is_json(spark, data, name):
    model = make(name, **MODELS[name]).fit(data)
    v = json.loads(model_json(spark, model, ["a", "b"]))
    assert len(v) > 1 and "object at" not in json.dumps(v)
    if name in ("decision_tree", "gbm"):
        tree = v["root"] if name == "decision_tree" else v["trees"][0]
        assert tree["feature"] == "a" and tree["threshold"] == pytest.approx(3.5, abs=0.51)


def test_models_without_a_text_are_described_by_json(spark, data):
    nb = bayes.naive_bayes_fit(data, ["a", "b"], "label")
    assert json.loads(describe(spark, nb).first()["line"])["kind"] == "naive_bayes"
    net = AveragedNetwork([2, 2, 2], np.arange(12.0))
    assert json.loads(describe(spark, net).first()["line"])["layers"] == [2, 2, 2]


def test_saved_histogram_and_table_models(spark, data, tmp_dir):
    m = fit_histogram_boosting(data, ["a"], ["u"], rounds=2, depth=2)
    back = load_model(save_model(m, f"{tmp_dir}/h"))
    assert model_json(spark, back) == model_json(spark, m) and back.losses == m.losses
    cols = ["a", "u", "prediction", "p0"]
    assert sorted(map(tuple, back.transform(data).select(*cols).collect())) == sorted(map(tuple, m.transform(data).select(*cols).collect()))
    nb = bayes.naive_bayes_fit(data.withColumn("wide", F.concat("u", F.col("a"), F.col("b"))), ["a", "b"], "wide")
    assert isinstance(nb, bayes.NaiveBayesTableModel)
    again = load_model(save_model(nb, f"{tmp_dir}/n"))
    score = lambda x: sorted(map(tuple, x.transform(data.select("a", "b")).collect()))
    assert score(again) == score(nb)


def test_blocks_of_classes_change_nothing(spark, data, monkeypatch):
    rows = data.withColumn("wide", F.concat("u", F.col("a").cast("int"), F.col("b").cast("int"))).select("a", "b", "wide")
    score = lambda: sorted(map(tuple, bayes.naive_bayes_fit(rows, ["a", "b"], "wide").transform(rows).collect()))
    whole = score()
    monkeypatch.setattr(bayes, "BLOCK_CELLS", 180)
    monkeypatch.setattr(bayes, "MERGE_BLOCKS", 2)
    assert score() == whole


def test_naive_bayes_with_null_features_and_classes(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (None, 2.0, None), (0.0, 1.0, "y")], "a double, b double, label string")
    m = bayes.naive_bayes_fit(df, ["a", "b"], "label")
    assert m.labels == [None, "x", "y"] and m.transform(df).count() == 3
    with pytest.raises(ValueError):
        bayes.naive_bayes_fit(df.where("a > 5"), ["a", "b"], "label")


def test_sums_in_pieces(spark):
    def part(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield from piece_rows(np.arange(10.0) * i, 4)

    df = spark.range(0, 100, 1, 9).mapInPandas(part, PIECES)
    assert np.allclose(summed(df, 10, 4), np.arange(10.0) * 4950)
    assert np.array_equal(summed(df.where("piece < 0"), 3), np.zeros(3))


def test_importances_of_given_weights():
    net = AveragedNetwork([2, 1, 1], np.array([3.0, -1.0, 0.5, 2.0, 0.1]))
    assert np.allclose(weight_importances(net), [0.75, 0.25])
    assert np.array_equal(weight_importances(AveragedNetwork([2, 1, 1], np.zeros(5))), [0, 0])


def test_tree_of_the_built_in_kind_keeps_its_levels(spark, data):
    m = builtin.decision_tree(max_depth=1).fit(data)
    assert set(json.loads(model_json(spark, m))["root"]) == {"feature", "threshold", "left", "right"}
