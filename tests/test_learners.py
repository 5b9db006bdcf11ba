"""Learner checks: closed forms, golden constants of the stored boosted model, signal, export."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from auger.operators.learners.bayes import naive_bayes_fit
from auger.operators.learners.boosting import fit_boosting, leaf_value, start_values
from auger.operators.learners.sgd import sgd_linear, sgd_linear_vector

from paths import SF_MID


def test_boosting_golden_constants():
    # priors of the stored two-class model: 481 / 3322 and 2841 / 3322
    p0, p1 = 481 / 3322, 2841 / 3322
    assert start_values([p0, p1])[0] == pytest.approx(-0.8880220558742132, abs=1e-12)
    n = 100  # pure leaf of the first tree: every residual equals 1 - p0 (class 0) or -p0
    assert leaf_value(2, n * (1 - p0), n * (1 - p0) * p0) == pytest.approx(3.4532218, abs=1e-6)
    assert leaf_value(2, -n * p0, n * p0 * (1 - p0)) == pytest.approx(-0.58465326, abs=1e-7)
    assert leaf_value(2, 0.0, 0.0) == 0.0


def test_naive_bayes_matches_spark_ml(spark):
    rows = [(float(i % 3), float(i % 5), float((i * 7) % 4), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double")
    agg = naive_bayes_fit(df, ["a", "b", "c"], "label")
    vec = df.select("label", F.array("a", "b", "c").alias("arr"))
    from pyspark.ml.functions import array_to_vector
    ml = NaiveBayes(smoothing=1.0).fit(vec.select("label", array_to_vector("arr").alias("features")))
    assert np.allclose(np.array(agg.log_prior), ml.pi.toArray(), atol=1e-12)
    assert np.allclose(np.array(agg.log_theta), ml.theta.toArray(), atol=1e-12)


def test_sgd_vector_equals_columns(spark):
    rows = [(float(i % 2), Vectors.dense([i / 10.0, (i * 3 % 7) / 7.0])) for i in range(50)]
    df = spark.createDataFrame(rows, ["label", "features"])
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col("features"))
    for loss, reg in (("logistic", 0.0), ("hinge", 0.01)):
        a = sgd_linear(df, [arr[0], arr[1]], "label", loss, 5, 1.0, reg)
        b = sgd_linear_vector(df, "features", "label", loss, 5, 1.0, reg)
        assert np.allclose(a.weights, b.weights, atol=1e-12)


def _docs(spark):
    from auger.plans.q_learners import _split, doc_features, labelled_docs
    return _split(labelled_docs(spark, SF_MID)), _split(doc_features(spark, SF_MID))


def test_learners_beat_majority(spark):
    from auger.operators.learners import builtin as B
    from auger.operators.scoring import score
    (tr, te), (dtr, dte) = _docs(spark)
    maj = te.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    for est in (B.decision_tree(), B.gbm()):
        acc = score(est.fit(tr), te).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert acc >= maj
    m = fit_boosting(dtr, "features", "lang_idx", None, rounds=3, depth=4)
    acc = m.transform(dte).agg(F.avg((F.col("prediction") == F.col("lang_idx")).cast("double"))).first()[0]
    maj4 = dte.groupBy("lang_idx").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert acc > maj4


def test_tree_sql_export_equals_model(spark):
    from pyspark.ml.functions import vector_to_array
    from auger.operators.learners import builtin as B
    from auger.sources.models import tree_to_sql
    (tr, te), _ = _docs(spark)
    for est in (B.decision_tree(), B.gbm(trees=3)):
        m = est.fit(tr)
        ex = tree_to_sql(spark, m)
        out = (m.transform(te.withColumn("_features_arr", vector_to_array("features")))
               .withColumn("sql_pred", F.expr(ex["prediction"])))
        assert out.where(F.col("sql_pred") != F.col("prediction")).count() == 0


def test_train_report_sections(spark):
    from auger.plans.q_learners import labelled_docs
    from auger.plans.train_report import train_and_report
    rep = train_and_report(spark, labelled_docs(spark, SF_MID), "GBM", key="doc_id")
    keys = {(r["section"], r["key"]) for r in rep["metrics"].collect()}
    assert ("auc", "auc") in keys and ("error", "test_error") in keys
    assert rep["confusion"].count() >= 2


def test_boosting_fit_reproduces_stored_model_constants(spark):
    # 481 rows of class 0 at x = 0 and 2841 of class 1 at x = 1: the first tree's leaves are pure
    rows = [(0.0, Vectors.dense([0.0])) for _ in range(481)] + [(1.0, Vectors.dense([1.0])) for _ in range(2841)]
    df = spark.createDataFrame(rows, ["label", "features"])
    m = fit_boosting(df, "features", "label", 2, rounds=1, depth=1, bins=2)
    assert m.init[0] == pytest.approx(-0.8880220558742132, abs=1e-12)
    gam = sorted(m.rounds[0].gammas[0].values())
    assert gam[0] == pytest.approx(-0.58465326, abs=1e-7)
    assert gam[1] == pytest.approx(3.4532218, abs=1e-6)


def test_tree_sql_with_categorical_splits(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from auger.sources.models import tree_rules, tree_to_sql
    rows = [(c, float(x), 1.0 if c in ("b", "d") else 0.0) for c in "abcde" for x in range(20)]
    df = spark.createDataFrame(rows, "c string, x double, label double")
    prep = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="ci"),
                            VectorAssembler(inputCols=["ci", "x"], outputCol="features")]).fit(df)
    data = prep.transform(df)
    m = DecisionTreeClassifier(maxDepth=3).fit(data)
    ex = tree_to_sql(spark, m)
    assert " IN (" in ex["prediction"]  # the split on the categorical slot is a set test
    out = (m.transform(data.withColumn("_features_arr", vector_to_array("features")))
           .withColumn("sql_pred", F.expr(ex["prediction"])))
    assert out.where(F.col("sql_pred") != F.col("prediction")).count() == 0
    rules, leaf_sql, _ = tree_rules(spark, m, ["c", "x"])
    assert any(" IN {" in r for r in rules.values())


def test_score_with_sql_per_tree_columns(spark):
    from auger.operators.learners import builtin as B
    from auger.sources.models import score_with_sql
    (tr, te), _ = _docs(spark)
    m = B.gbm(trees=4).fit(tr)
    out = score_with_sql(m.transform(te), m)
    assert out.where(F.col("sql_prediction") != F.col("prediction")).count() == 0
    from pyspark.ml.functions import vector_to_array
    diff = out.select(F.max(F.abs(F.col("sql_p1") - vector_to_array("probability")[1]))).first()[0]
    assert diff < 1e-9


def test_averaged_rectifier_network_beats_majority(spark):
    from auger.operators.learners.network import fit_network_averaged, n_params
    _, (dtr, dte) = _docs(spark)
    m = fit_network_averaged(dtr, 100, 4, hidden=(32,), epochs=5, label="lang_idx")
    assert len(m.theta) == n_params([100, 32, 4]) and len(m.history) == 5
    acc = m.transform(dte).agg(F.avg((F.col("prediction") == F.col("lang_idx")).cast("double"))).first()[0]
    maj = dte.groupBy("lang_idx").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert acc > maj


def test_boosting_history_decreases(spark):
    _, (dtr, _dte) = _docs(spark)
    m = fit_boosting(dtr, "features", "lang_idx", None, rounds=3, depth=3)
    assert len(m.history) == 3 and m.history[-1] < m.history[0]


def test_learners_repeatable_under_seed(spark):
    from auger.operators.learners import builtin as B
    from auger.operators.learners.network import fit_network_averaged
    (tr, te), (dtr, dte) = _docs(spark)

    def preds(df, col="prediction"):
        return [r[col] for r in df.orderBy("doc_id").select(col).collect()]

    for est in (B.decision_tree(), B.gbm(trees=3)):
        assert preds(est.fit(tr).transform(te)) == preds(est.fit(tr).transform(te))
    a = fit_boosting(dtr, "features", "lang_idx", None, rounds=2, depth=3)
    b = fit_boosting(dtr, "features", "lang_idx", None, rounds=2, depth=3)
    assert preds(a.transform(dte)) == preds(b.transform(dte))
    n1 = fit_network_averaged(dtr, 100, 4, hidden=(16,), epochs=2, label="lang_idx")
    n2 = fit_network_averaged(dtr, 100, 4, hidden=(16,), epochs=2, label="lang_idx")
    assert np.allclose(n1.theta, n2.theta)


def test_boosting_importances(spark):
    _, (dtr, _dte) = _docs(spark)
    m = fit_boosting(dtr, "features", "lang_idx", None, rounds=2, depth=3)
    imp = m.featureImportances.toArray()
    assert len(imp) == 100 and abs(imp.sum() - 1.0) < 1e-9 and (imp >= 0).all()


def test_report_runs_every_registered_learner(spark):
    from auger.plans.q_learners import labelled_docs
    from auger.plans.train_report import train_and_report
    df = labelled_docs(spark, SF_MID).transform(lambda d: d.checkpoint(eager=True))
    small = {"gbm_newton": {"rounds": 2, "depth": 3}, "deep_learning": {"n_in": 100, "hidden": (8,), "epochs": 2},
             "DEEP_LEARNING": {"n_in": 100, "hidden": (8,), "epochs": 2},
             "perceptron": {"n_in": 100, "hidden": (8,), "epochs": 5},
             "logistic_sgd": {"n_features": 100}, "svm_sgd": {"n_features": 100},
             "gbm": {"trees": 2}, "GBM": {"trees": 2}, "glm_cv": {"folds": 3}}
    from auger.operators.learners.registry import names
    for name in names():
        if name == "glm_cv":
            continue  # a CrossValidator: its model is the best fold model, reported like GLM
        rep = train_and_report(spark, df, name, key="doc_id", **small.get(name, {}))
        keys = {(r["section"], r["key"]) for r in rep["metrics"].collect()}
        assert ("error", "test_error") in keys, name


def test_learners_refuse_empty_training_sets(spark):
    from auger.operators.learners.glm import fit_glm
    empty = spark.createDataFrame([], "label double, a double")
    with pytest.raises(ValueError):
        naive_bayes_fit(empty, ["a"], "label")
    ev = spark.createDataFrame([(0.0, Vectors.dense([1.0]))], ["label", "features"]).where("label > 1")
    with pytest.raises(ValueError):
        fit_glm(ev)
    with pytest.raises(ValueError):
        fit_boosting(ev, "features", "label", 2, rounds=1)


def test_averaged_network_keeps_best_epoch(spark):
    from auger.operators.learners.network import fit_network_averaged
    _, (dtr, _dte) = _docs(spark)
    fit, valid = dtr.where(F.col("_b") < 7), dtr.where(F.col("_b") == 7)
    m = fit_network_averaged(fit, 100, 4, hidden=(16,), epochs=4, label="lang_idx", valid=valid)
    assert len(m.valid_history) == 4
    acc = m.transform(valid).agg(F.avg((F.col("prediction") == F.col("lang_idx")).cast("double"))).first()[0]
    assert abs(acc - max(m.valid_history)) < 1e-12


def _config_job(spark, tmp_dir, classes, positive=None, seed=3):
    import random

    from auger.sources.config import JobConfig
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        k = rng.randrange(len(classes))
        rows.append(f"{classes[k]},{k + rng.random() * 0.4:.4f},{rng.random():.4f},{'a' if k else 'b'}")
    path = f"{tmp_dir}/job.csv"
    open(path, "w").write("\n".join(rows))
    return JobConfig.from_properties("columns=y,x0,x1,c\nresponse=y\ncategorical=c\n" + (f"positive_label={positive}\n" if positive else ""), path)


@pytest.mark.parametrize("algorithm, settings", [
    ("logistic_sgd", {"iterations": 20}), ("svm_sgd", {"iterations": 20}), ("GLM", {}), ("GBM", {"trees": 3}),
    ("DEEP_LEARNING", {"hidden": (8,), "epochs": 3}), ("naive_bayes", {}), ("decision_tree", {})])
def test_every_algorithm_runs_from_a_config(spark, tmp_dir, algorithm, settings):
    from auger.plans.train_report import train_from_config
    rep = train_from_config(spark, _config_job(spark, tmp_dir, ["no", "yes"]), algorithm, **settings)
    got = {(r["section"], r["key"]): r["value"] for r in rep["metrics"].collect()}
    assert got["error", "test_error"] < 0.35
    assert 20 < rep["predictions"].count() < 100
    if algorithm == "GLM":
        assert got["glm", "residual_deviance"] <= got["glm", "null_deviance"]


def test_three_classes_and_positive_label_from_a_config(spark, tmp_dir):
    from auger.plans.train_report import train_from_config
    rep = train_from_config(spark, _config_job(spark, tmp_dir, ["p", "q", "r"]), "GBM", rounds=2)
    assert {(r["section"], r["key"]): r["value"] for r in rep["metrics"].collect()}["error", "test_error"] < 0.2
    import os
    os.mkdir(f"{tmp_dir}/b")
    rep = train_from_config(spark, _config_job(spark, f"{tmp_dir}/b", ["no", "yes"], positive="no"), "decision_tree")
    got = {(r["section"], r["key"]): r["value"] for r in rep["metrics"].collect()}
    assert got["auc", "auc"] > 0.9


def test_describe_a_glm(spark):
    from pyspark.ml.linalg import Vectors

    from auger.operators.learners.glm import fit_glm
    from auger.operators.scoring import describe
    df = spark.createDataFrame([(Vectors.dense([float(i % 5), float(i % 3)]), float(i % 5 > 2)) for i in range(60)], ["features", "label"])
    m = fit_glm(df, "features", "label", 0.5, 0.01, True, 20)
    rows = {r["term"]: r["coefficient"] for r in describe(spark, m).collect()}
    assert set(rows) == {"f0", "f1", "(intercept)"} and rows["f0"] > abs(rows["f1"])


def test_own_models_survive_a_round_trip(spark, tmp_dir):
    from auger.operators.learners.glm import fit_glm
    from auger.operators.learners.network import AveragedNetwork
    from auger.operators.learners.registry import make
    from auger.sources.models import load_model, save_model
    df = spark.createDataFrame([(Vectors.dense([float(i % 5), float(i % 7)]), float(i % 5 > 2), float(i % 5), float(i % 7)) for i in range(90)],
                               ["features", "label", "a", "b"])
    models = {"glm": fit_glm(df, "features", "label", 0.5, 0.01, True, 20), "boost": fit_boosting(df, rounds=2, depth=2),
              "boost3": fit_boosting(df.withColumn("label", F.pmod(F.col("a"), F.lit(3.0))), n_classes=3, rounds=1, depth=2),
              "net": AveragedNetwork([2, 3, 2], np.linspace(-1, 1, 2 * 3 + 3 + 3 * 2 + 2)), "nb": naive_bayes_fit(df, ["a", "b"], "label"),
              "sgd": make("logistic_sgd", n_features=2).fit(df), "tree": make("decision_tree").fit(df)}
    for name, m in models.items():
        back = load_model(save_model(m, f"{tmp_dir}/{name}"))
        assert type(back) is type(m)
        pick = lambda x: sorted(map(str, x.transform(df).select("a", "b", "prediction").collect()))
        assert pick(back) == pick(m), name


def test_network_does_not_depend_on_the_layout(spark):
    from auger.operators.learners.network import fit_network_averaged
    rows = [(Vectors.dense([float(i % 7), float(i % 5)]), i % 2, i) for i in range(200)]
    df = spark.createDataFrame(rows, ["features", "label", "i"])
    one, four = df.repartition(1), df.orderBy(F.desc("i")).repartition(4)
    a, b = (fit_network_averaged(d, 2, 2, hidden=(4,), epochs=2, rows_per_task=64).theta for d in (one, four))
    assert np.allclose(a, b, atol=1e-9)


def test_naive_bayes_tries_few_of_many_classes(monkeypatch):
    from auger.operators.learners import bayes as B
    rng = np.random.default_rng(5)
    n_c, sums = rng.integers(5, 50, 3000), rng.gamma(20.0, 30.0, (3000, 2))
    prior, theta = np.log(n_c / n_c.sum()), np.log(sums / sums.sum(axis=1, keepdims=True))
    prior[1::2], theta[1::2] = prior[::2], theta[::2]  # equal classes: the first one wins
    x = np.column_stack([rng.gamma(1.0, 30.0, 4000), rng.integers(0, 24, 4000)]).astype(float)
    scores = prior + x[:, :1] * theta[:, 0] + x[:, 1:] * theta[:, 1]
    used = B._leaders(prior, theta, x.min(axis=0), x.max(axis=0))
    assert len(used) < 300
    tried, look = [], B._few_best
    monkeypatch.setattr(B, "_few_best", lambda part, p, *rest: tried.append(len(part) * len(p)) or look(part, p, *rest))
    for some in (np.arange(len(prior)), used):
        s, at = B._best_classes(x, prior[some], theta[some])
        assert (some[at] == scores.argmax(axis=1)).all() and (s == scores.max(axis=1)).all()
    assert sum(tried) < scores.size / 5
    x[3, 0], x[5, 1], x[7] = np.nan, np.inf, [np.inf, np.nan]
    s, at = B._best_classes(x, prior, theta)
    old_s, old_at = B._plain_best(x, prior, theta)
    assert (at == old_at).all() and np.allclose(s, old_s, equal_nan=True)
    wide, w_theta = rng.gamma(1.0, 5.0, (300, 40)), np.log(rng.dirichlet(np.ones(40), 400))  # nothing to leave out
    w_prior = np.full(400, -np.log(400))
    assert (B._best_classes(wide, w_prior, w_theta)[1] == (wide @ w_theta.T + w_prior).argmax(axis=1)).all()
    assert len(B._leaders(w_prior, w_theta, wide.min(axis=0), wide.max(axis=0))) == 400
