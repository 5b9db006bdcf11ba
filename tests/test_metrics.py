import numpy as np
import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from auger.operators import metrics as M
from auger.operators.running import running_totals


def test_running_totals_many_buckets(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(5000).astype(float)
    v = rng.integers(0, 10, 5000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "v": v}))
    got = running_totals(df, "x", ["v"], n_buckets=37).toPandas().sort_values("x")
    exp = pd.DataFrame({"x": x, "v": v}).sort_values("x")
    assert (got["v_run"].to_numpy() == exp["v"].cumsum().to_numpy()).all()
    assert (got["v_total"] == v.sum()).all()
    got_d = running_totals(df, "x", ["v"], descending=True, n_buckets=11).toPandas().sort_values("x", ascending=False)
    assert (got_d["v_run"].to_numpy() == exp["v"][::-1].cumsum().to_numpy()).all()


def test_auc_matches_evaluator_with_ties(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000).astype(float)
    p = np.round(rng.random(3000) + 0.3 * y, 2)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "p1": p}))
    ours = M.auc(df, "p1", "label").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="label").evaluate(df)
    assert abs(ours - ev) < 1e-12


def test_sweep_counts_add_up(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 7)) for i in range(100)], "label double, p1 double")
    sw = M.threshold_sweep(df, "p1", "label").collect()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 100 for r in sw)
    assert M.best_threshold(M.threshold_sweep(df, "p1", "label")).count() == 1


def test_permuted_copies_keep_values(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from auger.operators.scoring import permuted_copies
    df = spark.createDataFrame([(i, Vectors.dense([float(i), float(i % 7), 5.0])) for i in range(3000)], ["id", "f"])
    cp = permuted_copies(df, "f", 3, group_rows=100).withColumn("a", vector_to_array("f"))
    rows = cp.select("id", "_perm_j", "a").collect()
    by_j = {}
    for r in rows:
        by_j.setdefault(r["_perm_j"], []).append((r["id"], list(r["a"])))
    assert sorted(by_j) == [-1, 0, 1, 2]
    base = {i: a for i, a in by_j[-1]}
    assert all(a == [float(i), float(i % 7), 5.0] for i, a in by_j[-1])
    for j in (0, 1, 2):
        got = by_j[j]
        assert sorted(a[j] for _, a in got) == sorted(base[i][j] for i, _ in got)  # same multiset
        assert all(a[o] == base[i][o] for i, a in got for o in range(3) if o != j)  # others untouched
    moved = sum(1 for i, a in by_j[0] if a[0] != base[i][0])
    assert moved > 2500


def test_ordered_positions_spans_partitions(spark):
    from auger.functions.encoding import ordered_positions
    rows = [("big", f"v{i:05d}") for i in range(5000)] + [("small", s) for s in ("b", "a", "c")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = ordered_positions(df, "g", "v", "pos", partitions=16).collect()
    pos = {(r["g"], r["v"]): r["pos"] for r in got}
    assert [pos[("small", s)] for s in ("a", "b", "c")] == [0, 1, 2]
    assert all(pos[("big", f"v{i:05d}")] == i for i in range(5000))


def test_first_split_is_exact_for_many_values_and_nulls(spark):
    from auger.plans.q_learners import first_split_table
    rows = [(float(i), i % 3 + 0.0, "a" if i < 700 else "b") for i in range(1000)] + [(None, None, "a")] * 300 + [(5.0, None, None)] * 2
    df = spark.createDataFrame(rows, "x double, y double, c string")
    got = {r["feature"]: r for r in first_split_table(df, ["x", "y"], "c").collect()}

    def brute(k):
        best = None
        for t in sorted({r[k] for r in rows if r[k] is not None}):
            left = [r[2] for r in rows if r[k] is None or r[k] <= t]
            right = [r[2] for r in rows if not (r[k] is None or r[k] <= t)]
            if right:
                part = sum(sum(side.count(c) ** 2 for c in ("a", "b", None)) / len(side) for side in (left, right))
                g = 1 - part / len(rows)
                if best is None or round(g, 12) < round(best[1], 12):
                    best = (t, g, len(left))
        return best
    for k, f in enumerate(("x", "y")):
        t, g, n = brute(k)
        assert (got[f]["threshold"], got[f]["n_left"]) == (t, n) and abs(got[f]["gini"] - g) < 1e-9


def test_rank_metrics_leave_unscored_rows_out(spark):
    rows = [(float(i % 2), i / 50) for i in range(50)] + [(1.0, None), (0.0, None)]
    df = spark.createDataFrame(rows, "label double, p1 double")
    full = spark.createDataFrame(rows[:50], "label double, p1 double")
    assert M.auc(df).first() == M.auc(full).first()
    assert sorted(map(tuple, M.threshold_sweep(df).collect())) == sorted(map(tuple, M.threshold_sweep(full).collect()))
    assert tuple(M.unscored(df).first()) == (2, 52)


def test_counts_beyond_a_long_product(spark):
    big = spark.createDataFrame([(0.1, 9_000_000_000, 0), (0.9, 6_000_000_000, 6_000_000_000)], "p double, cnt long, pos long")
    assert M.auc(table=big).first()["auc"] == 1.0


def test_metrics_on_empty_input(spark):
    empty = spark.createDataFrame([], "label double, p1 double, prediction double")
    assert M.auc(empty, "p1", "label").first()["auc"] is None
    assert M.threshold_sweep(empty, "p1", "label").count() == 0
    assert M.test_error(empty).first()["n_rows"] == 0
    assert M.summary(empty, prob="p1").first()["n_rows"] == 0
    one_class = spark.createDataFrame([(1.0, 0.3, 1.0), (1.0, 0.7, 1.0)], "label double, p1 double, prediction double")
    assert M.auc(one_class, "p1", "label").first()["auc"] is None  # undefined without negatives


def test_network_scoring_sends_only_its_inputs_through_python(spark):
    from pyspark.ml.linalg import Vectors
    from auger.operators.learners.network import AveragedNetwork, _forward, _unpack, n_params
    net = AveragedNetwork([3, 4, 2], np.linspace(-1, 1, n_params([3, 4, 2])), features="f")
    rows = [(i, "x", Vectors.dense([i / 10, float(i % 3), -i / 7])) for i in range(50)]
    out = net.transform(spark.createDataFrame(rows, ["id", "a.b", "f"]))
    assert out.columns == ["id", "a.b", "f", "p0", "p1", "prediction"]
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()  # which would pass every column
    P = _forward(_unpack(net.theta, net.layers), np.array([r[2].toArray() for r in rows]))[-1]
    got = out.orderBy("id").collect()
    assert np.allclose([[r["p0"], r["p1"]] for r in got], P) and [r["prediction"] for r in got] == P.argmax(axis=1).tolist()
    assert [r["f"] for r in got] == [r[2] for r in rows]
