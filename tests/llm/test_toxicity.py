import numpy as np
from pyspark.sql import functions as F

from auger.llm import toxicity as T


def synthetic(n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        grade = int(rng.choice(3, p=[0.7, 0.2, 0.1]))
        w = [f"w{rng.integers(0, 900)}" for _ in range(rng.integers(5, 120))]
        w += [f"bad{rng.integers(0, 5)}" for _ in range(2 * (grade > 0))] + ["awful"] * (grade == 2)
        rng.shuffle(w)
        rows.append((i, " ".join(w), grade))
    return rows


def test_held_out_grades(spark):
    rows = synthetic()
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = T.fit(df.select("doc_id", "text"), df.where("doc_id % 3 > 0").select("doc_id", "grade"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    awful = T.Words(["awful"]).hash[0]
    assert model.weights[model.features == awful][0] > 5 * np.abs(model.weights).mean()  # noise keeps little weight
    got = {r["doc_id"]: r for r in T.predict(df.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[d]["toxic"] == (g > 0) for d, _, g in held]) > 0.97
    assert np.mean([got[d]["grade"] == g for d, _, g in held]) > 0.93
    mean = [np.mean([got[d]["expected_severity"] for d, _, g in held if g == k]) for k in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(1)
    off = np.arange(0, 401, 2)
    index = rng.integers(0, 30, 400)
    true = np.zeros(30)
    true[:3] = (4, 2, -3)
    eta = np.add.reduceat(true[index], off[:-1])
    grade = (eta > 0.5).astype(int) + (eta > 3.5)
    w, th = T.fit_ordinal(index, off, grade, 30, 3, l1=1e-4)
    score = np.add.reduceat(w[index], off[:-1])
    assert ((score > th[0]).astype(int) + (score > th[1]) == grade).mean() > 0.97


def test_query_on_labelled_documents(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_toxicity"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id")
    wrong = both.where((F.col("label") == 0) & F.col("toxic")).count()
    found = both.where((F.col("label") == 1) & F.col("toxic")).count()
    assert wrong <= 3 and found >= 0.7 * both.where("label = 1").count()


def test_odd_rows(spark, odd_docs, no_docs):
    grades = spark.createDataFrame([(4, 0), (6, 1), (9, None), (None, 1), (99, 2)], "doc_id long, grade int")
    model = T.fit(odd_docs, grades)
    rows = T.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["expected_severity"] <= 2 for r in rows)
    none = T.fit(no_docs, grades)
    assert {r["toxic"] for r in T.predict(odd_docs, none).collect()} == {False}
    assert T.predict(no_docs, model).count() == 0


def test_a_third_of_the_rows_are_toxic_copies(spark):
    rng = np.random.default_rng(3)
    clean = [(i, " ".join(f"w{k}" for k in rng.integers(0, 900, 40)) + " the", 0) for i in range(400)]
    copies = [(1000 + i, "you vile rotten creature the", 1) for i in range(200)]
    df = spark.createDataFrame(clean + copies, "doc_id long, text string, grade int")
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    new = spark.createDataFrame([(1, "such a vile rotten thing"), (2, ""), (3, None), (4, "the w1 w2 w3")], "doc_id long, text string")
    assert {r["doc_id"] for r in T.predict(new, model).collect() if r["toxic"]} == {1}
    got = T.predict(df, model).collect()
    assert all(r["toxic"] == (r["doc_id"] >= 1000) for r in got)


def plain_loss(w, thresholds, rows, grades, l1):
    """The objective written out for rows as lists of features."""
    total = 0.0
    for features, g in zip(rows, grades):
        eta = sum(w[f] for f in features)
        edge = [0.0] + [1 / (1 + np.exp(eta - t)) for t in thresholds] + [1.0]
        total -= np.log(max(edge[g + 1] - edge[g], 1e-300))
    return total / len(rows) + l1 * np.abs(w).sum()


def test_fit_reaches_the_optimum_of_a_plain_solver():
    rng = np.random.default_rng(8)
    n, d, l1 = 120, 6, 0.01
    rows = [sorted(rng.choice(d, rng.integers(0, 4), replace=False).tolist()) for _ in range(n)]
    true = np.array([2.5, 1.0, 0.0, -1.5, 0.0, 0.3])
    eta = np.array([true[r].sum() for r in rows]) + rng.logistic(size=n)
    grades = (eta > 0.5).astype(int) + (eta > 2.0)
    index = np.array([f for r in rows for f in r])
    w, th = T.fit_ordinal(index, np.cumsum([0] + list(map(len, rows))), grades, d, 3, l1, steps=4000)
    # coordinate search from zero: each parameter in turn, with steps that shrink
    x = np.concatenate((np.zeros(d), [0.0, 1.0]))
    loss = lambda x: plain_loss(x[:d], x[d:], rows, grades, l1) if x[d] < x[d + 1] else np.inf
    best, step = loss(x), 1.0
    while step > 1e-5:
        moved = False
        for j in range(len(x)):
            for s in (step, -step):
                y = x.copy()
                y[j] = 0.0 if j < d and x[j] * (x[j] + s) < 0 else x[j] + s
                value = loss(y)
                if value < best - 1e-13:
                    x, best, moved = y, value, True
        step = step if moved else step / 2
    assert abs(plain_loss(w, th, rows, grades, l1) - best) < 1e-5
    assert np.abs(w - x[:d]).max() < 0.02


def test_predict_equals_a_dictionary(spark):
    import re
    texts = ["one awful thing", "Awful awful AWFUL", "nothing here", "", None, "unknownword awf awfully", "x" * 9000 + " awful"]
    feature = {}
    for p, words in ((None, ("awful", "nothing")), (4, ("awfu", "noth")), (6, ("nothin",))):
        for x in words:
            w = T.Words([x], prefixes=T.PREFIXES)
            feature[p, x] = w.hash[0] if p is None else T.mix(w.prefix[p] + np.uint64(p))[0]
    weight = dict(zip(feature, (1.5, -0.7, 0.4, -0.2, 0.1)))
    order = sorted(feature, key=lambda k: int(feature[k]))
    model = T.Model(np.array([feature[k] for k in order], dtype=np.uint64), np.array([weight[k] for k in order]), np.array([0.5, 1.5]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.predict(df, model).collect():
        words = set(re.findall(r"\w+", (texts[r["doc_id"]] or "").lower()))
        held = {(None, w) for w in words} | {(p, w[:p]) for w in words for p in T.PREFIXES}
        eta = sum(v for k, v in weight.items() if k in held)
        edge = 1 / (1 + np.exp(eta - model.thresholds))
        p = np.diff([0.0, *edge, 1.0])
        assert abs(r["expected_severity"] - (p[1] + 2 * p[2])) < 1e-12
        assert r["grade"] == p.argmax() and r["toxic"] == (edge[0] <= 1 - T.TOXIC_AT)
