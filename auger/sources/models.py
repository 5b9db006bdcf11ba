"""Model export and re-use.

``save_model``/``load_model`` use Spark ML's writers (any fitted stage or pipeline) and write this package's own
models as Parquet. For tree
models the saved node table is also turned into a SQL ``CASE`` expression, so a tree or a
boosted ensemble can score any table with ``selectExpr``: whole-stage codegen compiles it and
no model object is needed at scoring time. The node table is tiny (at most 2^(depth+1) rows per
tree) and is the only thing read back to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auger.functions.encoding import LevelDictionary
from auger.operators.learners.bayes import NaiveBayesAggModel, NaiveBayesTableModel
from auger.operators.learners.boosting import BoostRound, MultiBoostModel
from auger.operators.learners.glm import GlmModel
from auger.operators.learners.histogram_trees import Binning, HistogramBoostModel, Split, Tree
from auger.operators.learners.network import AveragedNetwork
from auger.operators.learners.registry import _SgdModel
from auger.operators.learners.sgd import LinearSgdModel
from auger.session import scratch_path


_OWN = "auger_model"


@dataclass
class PreparedModel:
    """A fitted preparation (Spark ML pipeline) and a model of this package: scores raw cleaned rows."""

    prep: PipelineModel
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prep.transform(df))


def _parts(model) -> tuple[dict, list[float], dict[str, object]] | None:
    """Settings, numbers and Spark ML parts of one of this package's models; None for others."""
    if isinstance(model, PreparedModel):
        return {}, [], {"prep": model.prep, "model": model.model}
    if isinstance(model, GlmModel):
        return {"intercept": float(model.intercept), "iterations": int(model.iterations), "features": model.features}, list(model.coefficients), {}
    if isinstance(model, AveragedNetwork):
        return {"layers": list(model.layers), "features": model.features}, list(model.theta), {}
    if isinstance(model, NaiveBayesAggModel):
        theta = [x for row in model.log_theta for x in row]
        return {"labels": list(model.labels), "features": list(model.features)}, [*model.log_prior, *theta], {}
    if isinstance(model, LevelDictionary):
        return {"columns": model.columns, "n_levels": model.n_levels}, [], {}
    if isinstance(model, NaiveBayesTableModel):
        return {"features": model.features}, [], {}
    if isinstance(model, HistogramBoostModel):
        b = model.binning
        rounds = [[[{str(i): [s.feature, s.cut, None if s.left is None else s.left.tolist(), s.gain] for i, s in t.splits.items()},
                    t.stats, t.values] for t in trees] for trees in model.rounds]
        settings = {"numeric": b.numeric, "categorical": b.categorical, "n_bins": b.n_bins, "n_classes": model.n_classes,
                    "rate": model.rate, "rounds": rounds, "losses": model.losses}
        return settings, list(model.start), {"levels": b.levels} if b.levels else {}
    if isinstance(model, LinearSgdModel):
        return {"loss": model.loss, "threshold": model.threshold}, list(model.weights), {}
    if isinstance(model, _SgdModel):
        return {"features": model.features, "n_features": model.n_features}, [], {"inner": model.inner}
    if isinstance(model, MultiBoostModel):
        gammas = [[sorted(g.items()) for g in r.gammas] for r in model.rounds]
        trees = {f"tree_{i}_{k}": t for i, r in enumerate(model.rounds) for k, t in enumerate(r.trees)}
        return {"n_classes": model.n_classes, "rate": model.rate, "features": model.features, "gammas": gammas}, list(model.init), trees
    return None


def _built(kind: str, s: dict, numbers: list[float], part: Callable[[str], object]):
    if kind == "PreparedModel":
        return PreparedModel(part("prep"), part("model"))
    if kind == "GlmModel":
        return GlmModel(np.array(numbers), s["intercept"], s["iterations"], features=s["features"])
    if kind == "AveragedNetwork":
        return AveragedNetwork(s["layers"], np.array(numbers), s["features"])
    if kind == "NaiveBayesAggModel":
        k, d = len(s["labels"]), len(s["features"])
        theta = [numbers[k + c * d:k + (c + 1) * d] for c in range(k)]
        return NaiveBayesAggModel(s["labels"], numbers[:k], theta, s["features"])
    if kind == "HistogramBoostModel":
        binning = Binning([tuple(x) for x in s["numeric"]], s["categorical"], part("levels") if s["categorical"] else None, s["n_bins"])
        model = HistogramBoostModel(binning, s["n_classes"], numbers, s["rate"], losses=[tuple(x) for x in s["losses"]])
        for trees in s["rounds"]:
            model.rounds.append([Tree(
                {int(i): Split(f, c, None if lv is None else np.array(lv, dtype=np.int64), g) for i, (f, c, lv, g) in splits.items()},
                {int(i): tuple(v) for i, v in stats.items()}, {int(i): v for i, v in values.items()}) for splits, stats, values in trees])
        return model
    if kind == "LinearSgdModel":
        return LinearSgdModel(numbers, s["loss"], threshold=s["threshold"])
    if kind == "_SgdModel":
        return _SgdModel(part("inner"), s["features"], s["n_features"])
    if kind == "MultiBoostModel":
        model = MultiBoostModel(s["n_classes"], numbers, s["rate"], s["features"])
        for i, round_ in enumerate(s["gammas"]):
            trees = [part(f"tree_{i}_{k}") for k in range(len(round_))]
            model.rounds.append(BoostRound(trees, [{float(a): float(b) for a, b in g} for g in round_]))
        return model
    raise ValueError(f"unknown model kind {kind!r}")


def save_model(model, path: str, overwrite: bool = True) -> str:
    """Write any fitted Spark ML stage or pipeline with its own writer, and the models of this package as
    a one-row Parquet table (kind, settings as JSON, numbers) beside their Spark ML parts."""
    own = _parts(model)
    if isinstance(model, (LevelDictionary, NaiveBayesTableModel)):
        model.table.write.mode("overwrite" if overwrite else "error").parquet(f"{path}/table")
    if own is None:
        w = model.write()
        if overwrite:
            w = w.overwrite()
        w.save(path)
        return path
    settings, numbers, parts = own
    row = (type(model).__name__, json.dumps(settings), [float(x) for x in numbers])
    spark = SparkSession.getActiveSession()
    (spark.createDataFrame([row], "kind string, settings string, numbers array<double>")
     .write.mode("overwrite" if overwrite else "error").parquet(f"{path}/{_OWN}"))
    for name, m in parts.items():
        save_model(m, f"{path}/{name}", overwrite)
    return path


def load_model(path: str):
    """What :func:`save_model` wrote, as the class it had."""
    spark = SparkSession.getActiveSession()
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_OWN}")
    if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own):
        r = spark.read.parquet(f"{path}/{_OWN}").first()  # one row
        s = json.loads(r["settings"])
        if r["kind"] == "LevelDictionary":
            return LevelDictionary(spark.read.parquet(f"{path}/table"), s["columns"], s["n_levels"])
        if r["kind"] == "NaiveBayesTableModel":
            return NaiveBayesTableModel(spark.read.parquet(f"{path}/table"), s["features"])
        return _built(r["kind"], json.loads(r["settings"]), list(r["numbers"]), lambda name: load_model(f"{path}/{name}"))
    return DefaultParamsReader.loadParamsInstance(path, spark)


def _nodes_of(spark: SparkSession, model) -> dict[int, list[dict]]:
    """treeID -> node rows of a saved tree or ensemble."""
    path = scratch_path(spark, "model-nodes")
    model.write().save(path)
    df = spark.read.parquet(path + "/data")
    trees: dict[int, list[dict]] = {}
    if "treeID" in df.columns:
        for r in df.select("treeID", "nodeData.*").collect():
            trees.setdefault(r["treeID"], []).append(r.asDict(recursive=True))
    else:
        trees[0] = [r.asDict(recursive=True) for r in df.collect()]
    return trees


def tree_weights(spark: SparkSession, model) -> list[float]:
    if hasattr(model, "treeWeights"):
        return list(model.treeWeights)
    return [1.0]


def _case(nodes: dict[int, dict], nid: int, feat: Callable[[int], str], leaf: Callable[[dict], str]) -> str:
    n = nodes[nid]
    if n["leftChild"] < 0:
        return leaf(n)
    s = n["split"]
    f = feat(s["featureIndex"])
    vals = s["leftCategoriesOrThreshold"]
    if s["numCategories"] is not None and s["numCategories"] >= 0:
        cond = f"{f} IN ({', '.join(repr(float(v)) for v in vals)})" if vals else "FALSE"
    else:
        cond = f"{f} <= {float(vals[0])!r}"
    return (f"CASE WHEN {cond} THEN {_case(nodes, n['leftChild'], feat, leaf)} "
            f"ELSE {_case(nodes, n['rightChild'], feat, leaf)} END")


def default_feature(arr: str = "_features_arr") -> Callable[[int], str]:
    return lambda i: f"{arr}[{i}]"


def tree_sql(nodes: list[dict], feat: Callable[[int], str], value: str = "prediction") -> str:
    """One tree as CASE text; ``value`` = ``prediction`` (leaf value) or ``node`` (leaf node id)."""
    by_id = {n["id"]: n for n in nodes}
    root = min(by_id)
    if value == "node":
        return _case(by_id, root, feat, lambda n: str(int(n["id"])))
    return _case(by_id, root, feat, lambda n: repr(float(n["prediction"])))


def tree_to_sql(spark: SparkSession, model, feat: Callable[[int], str] | None = None) -> dict[str, str]:
    """SQL texts for a fitted tree model.

    Decision tree: ``{"prediction"}``. Boosted two-class ensemble: ``{"margin", "p1", "prediction"}``
    with ``p1 = 1 / (1 + exp(-2 margin))`` and prediction ``margin > 0``.
    Features are referenced as ``feat(i)``, by default ``_features_arr[i]`` (``vector_to_array``).
    """
    feat = feat or default_feature()
    trees = _nodes_of(spark, model)
    name = type(model).__name__
    if name.startswith("GBT"):
        ws = tree_weights(spark, model)
        margin = " + ".join(f"({w!r}) * ({tree_sql(trees[t], feat)})" for t, w in zip(sorted(trees), ws))
        if name.startswith("GBTClassification"):
            return {"margin": margin, "p1": f"1.0 / (1.0 + exp(-2.0 * ({margin})))",
                    "prediction": f"CASE WHEN ({margin}) > 0.0 THEN 1.0 ELSE 0.0 END"}
        return {"prediction": margin}
    if name.startswith("RandomForest"):
        raise NotImplementedError("random forests are not part of this engine")
    return {"prediction": tree_sql(trees[0], feat)}


def score_with_sql(df: DataFrame, model, features: str = "features", prefix: str = "sql_") -> DataFrame:
    """Score ``df`` with the model's SQL text only (no model object in the tasks).

    An ensemble is evaluated one tree per column (``_t0``, ``_t1``, ...) and summed, so each
    generated method stays small whatever the number of trees. Adds ``sql_prediction`` (and
    ``sql_p1`` for a two-class boosted model).
    """
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    feat = default_feature()
    trees = _nodes_of(spark, model)
    name = type(model).__name__
    out = df.withColumn("_features_arr", vector_to_array(F.col(features)))
    if name.startswith("GBT"):
        ws = tree_weights(spark, model)
        cols = {f"_t{t}": F.expr(f"({w!r}) * ({tree_sql(trees[t], feat)})") for t, w in zip(sorted(trees), ws)}
        out = out.withColumns(cols)
        margin = sum((F.col(c) for c in cols), F.lit(0.0))
        if name.startswith("GBTClassification"):
            out = (out.withColumn(prefix + "p1", 1.0 / (1.0 + F.exp(-2.0 * margin)))
                   .withColumn(prefix + "prediction", F.when(margin > 0.0, 1.0).otherwise(0.0)))
        else:
            out = out.withColumn(prefix + "prediction", margin)
        return out.drop("_features_arr", *cols)
    return out.withColumn(prefix + "prediction", F.expr(tree_sql(trees[0], feat))).drop("_features_arr")


def tree_rules(spark: SparkSession, model, names: list[str] | None = None) -> tuple[dict[int, str], str, list[dict]]:
    """Leaf node id -> readable rule text (``a <= 1.5 AND b > 3``), plus the leaf-id SQL."""
    nodes = _nodes_of(spark, model)[0]
    by_id = {n["id"]: n for n in nodes}

    def nm(i):
        return names[i] if names and i < len(names) else f"f{i}"

    rules: dict[int, str] = {}

    def walk(nid: int, conds: list[str]):
        n = by_id[nid]
        if n["leftChild"] < 0:
            rules[int(n["id"])] = " AND ".join(conds) if conds else "TRUE"
            return
        s = n["split"]
        vals = s["leftCategoriesOrThreshold"]
        if s["numCategories"] is not None and s["numCategories"] >= 0:
            lt = f"{nm(s['featureIndex'])} IN {{{', '.join(str(v) for v in vals)}}}"
            rt = f"{nm(s['featureIndex'])} NOT IN {{{', '.join(str(v) for v in vals)}}}"
        else:
            lt = f"{nm(s['featureIndex'])} <= {vals[0]:g}"
            rt = f"{nm(s['featureIndex'])} > {vals[0]:g}"
        walk(n["leftChild"], conds + [lt])
        walk(n["rightChild"], conds + [rt])

    walk(min(by_id), [])
    return rules, tree_sql(nodes, default_feature(), "node"), nodes
