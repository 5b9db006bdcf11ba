import random

import pytest
from pyspark.sql import functions as F

from auger.functions import encoding
from auger.functions.encoding import LevelDictionary
from auger.operators.learners import histogram_trees as H
from auger.plans.train_report import train_from_config
from auger.sources.config import JobConfig, LabelSpec


def rows(n=400, levels=1664, seed=3):
    g = random.Random(seed)
    good = {f"L{i:04d}" for i in range(0, levels, 3)}
    out = []
    for i in range(n):
        u, x = f"L{g.randrange(levels):04d}", g.random()
        out.append((i, x, u, int((u in good) != (x > 0.9)), g.random() < 0.2))
    return out


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(rows(6000), "id int, x double, u string, label int, valid boolean").repartition(4).cache()


def test_level_sets_over_hundreds_of_levels(spark, wide):
    m = H.fit_histogram_boosting(wide, ["x"], ["u"], valid="valid", rounds=4, depth=3, rate=0.5)
    first = m.rounds[0][0].splits[0]
    assert first.left is not None and len(first.left) > 500
    losses = [x[1] for x in m.losses]
    assert losses == sorted(losses, reverse=True) and m.best_round() > 0
    scored = m.transform(wide.where("not valid"))
    assert scored.where("prediction = label").count() > 0.95 * scored.count()
    assert abs(scored.agg(F.avg(-F.log(F.when(F.col("label") == 0, F.col("p0")).otherwise(F.col("p1"))))).first()[0] - losses[-1]) < 1e-9


def test_sparse_sums_equal_dense_ones(wide, monkeypatch):
    fit = lambda: H.fit_histogram_boosting(wide, ["x"], ["u"], rounds=2, depth=2)
    a = fit()
    monkeypatch.setattr(H, "DENSE", 0)
    b = fit()
    for x, y in zip(a.rounds, b.rounds):
        for s, t in zip(x, y):
            assert s.splits.keys() == t.splits.keys()
            assert all(abs(s.values[i] - t.values[i]) < 1e-9 for i in s.values)


def test_rewritten_scores_change_nothing(wide, monkeypatch):
    fit = lambda: H.fit_histogram_boosting(wide, ["x"], rounds=4, depth=2, rate=0.3).losses
    a = fit()
    monkeypatch.setattr(H, "REWRITE", 1)
    assert [tuple(round(v, 9) for v in x[:2]) for x in fit()] == [tuple(round(v, 9) for v in x[:2]) for x in a]


def test_odd_rows(spark):
    data = [(None, None, 0), (float("nan"), "a", 1), (1.0, None, 0), (1.0, "b", 1), (1.0, "b", None), (-5.0, "", 0)] * 3
    df = spark.createDataFrame(data, "x double, u string, label int")
    m = H.fit_histogram_boosting(df, ["x"], ["u"], rounds=2, depth=2)
    new = spark.createDataFrame([(None, "unseen"), (9e9, "b"), (-9e9, None)], "x double, u string")
    assert all(0 < r["p0"] < 1 and r["p0"] + r["p1"] == pytest.approx(1) for r in m.transform(new).collect())
    same = spark.createDataFrame([(1.0, 0), (1.0, 0)], "x double, label int")
    assert m.n_classes == 2 and not H.fit_histogram_boosting(same, ["x"], rounds=1).rounds[0][0].splits
    with pytest.raises(ValueError):
        H.fit_histogram_boosting(same.where("x > 1"), ["x"])


def test_levels_by_dictionary(spark, monkeypatch, tmp_dir):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"v{i % 50:02d}", "k") for i in range(2000)], "id int, u string, level string")
    d = LevelDictionary.fit(df.where("id < 1000"), ["u", "level"])
    assert d.sizes() == {"u": 50, "level": 1}
    new = df.unionByName(spark.createDataFrame([(-1, "unseen", None)], df.schema))
    want = {r["id"]: None if r["u"] is None or r["id"] < 0 else int(r["u"][1:]) for r in new.collect()}
    for limit in (100_000, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(encoding, "BROADCAST_LEVELS", limit)
        got = d.transform(new, {"u": "u_at", "level": "level_at"}).collect()
        assert {r["id"]: r["u_at"] for r in got} == want and len(got) == 2001
    d.save(f"{tmp_dir}/levels")
    assert sorted(map(tuple, LevelDictionary.load(spark, f"{tmp_dir}/levels").table.collect())) == sorted(map(tuple, d.table.collect()))


def test_configured_job_with_level_sets(spark, wide, tmp_dir):
    path = f"{tmp_dir}/in"
    wide.select("id", "x", "u", "label").write.csv(path)
    cfg = JobConfig(path=path, names=("id", "x", "u", "label"), response=LabelSpec("last"), ignored=("id",), categorical=("u",), key="id")
    rep = train_from_config(spark, cfg, "gbm_histogram", rounds=4, depth=3, rate=0.5)
    got = {r["key"]: r["value"] for r in rep["metrics"].where("section in ('error', 'input')").collect()}
    assert got["rows"] == 6000 and got["bad_rows"] == 0 and rep["predictions"].count() > 1000
