"""every model as JSON text: one emitter per kind, numbers with a fixed count of digits."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from auger.operators.learners.bayes import NaiveBayesAggModel
from auger.operators.learners.boosting import MultiBoostModel
from auger.operators.learners.histogram_trees import HistogramBoostModel, Tree
from auger.operators.learners.network import AveragedNetwork, _unpack
from auger.operators.learners.registry import _SgdModel
from auger.operators.learners.sgd import LinearSgdModel
from auger.sources.models import PreparedModel, _nodes_of, tree_weights


def model_json(spark: SparkSession, model, names: list[str] | None = None, digits: int = 6) -> str:
    """The model as one JSON object. ``names`` are those of the feature vector's slots."""
    return _text(_value(spark, model, names), digits)


def _text(v, digits: int) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_text(x, digits)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_text(x, digits) for x in v) + "]"
    if isinstance(v, (float, np.floating)):
        return f"{float(v) + 0.0:.{digits}f}" if np.isfinite(v) else json.dumps(str(v))
    if isinstance(v, np.integer):
        return str(int(v))
    return json.dumps(v, ensure_ascii=False)


def _value(spark, model, names):
    if isinstance(model, PreparedModel):
        return _value(spark, model.model, names)
    if isinstance(model, NaiveBayesAggModel):
        classes = [{"label": v, "log_prior": p, "log_theta": t} for v, p, t in zip(model.labels, model.log_prior, model.log_theta)]
        return {"kind": "naive_bayes", "features": model.features, "classes": classes}
    if isinstance(model, HistogramBoostModel):
        rounds = [[_histogram_tree(t, 0, model) for t in trees] for trees in model.rounds]
        return {"kind": "boosted_trees", "classes": model.n_classes, "rate": float(model.rate), "start": model.start, "rounds": rounds}
    if isinstance(model, MultiBoostModel):
        rounds = [[_tree(spark, t, names, g) for t, g in zip(r.trees, r.gammas)] for r in model.rounds]
        return {"kind": "boosted_trees", "classes": model.n_classes, "rate": float(model.rate), "start": model.init, "rounds": rounds}
    if isinstance(model, AveragedNetwork):
        layers = [{"weights": W.tolist(), "biases": b.tolist()} for W, b in _unpack(np.asarray(model.theta), model.layers)]
        return {"kind": "network", "layers": model.layers, "parameters": layers}
    if isinstance(model, _SgdModel):
        return _value(spark, model.inner, names)
    if isinstance(model, LinearSgdModel):
        return {"kind": model.loss, "weights": [float(w) for w in model.weights], "threshold": None if model.threshold is None else float(model.threshold)}
    if hasattr(model, "coefficients"):
        coef = getattr(model.coefficients, "toArray", lambda: np.asarray(model.coefficients))()
        return {"kind": "linear", "intercept": float(model.intercept), "coefficients": [float(c) for c in coef]}
    if hasattr(model, "stages"):
        return {"kind": "pipeline", "stages": [_value(spark, s, names) for s in model.stages]}
    if hasattr(model, "trees") and hasattr(model, "treeWeights"):
        trees = [_nested(nodes, min(nodes), names) for _, nodes in sorted(_by_tree(spark, model).items())]
        return {"kind": type(model).__name__, "weights": [float(w) for w in tree_weights(spark, model)], "trees": trees}
    if hasattr(model, "toDebugString"):
        return {"kind": "tree", "root": _tree(spark, model, names)}
    params = {p.name: str(v) for p, v in model.extractParamMap().items()} if hasattr(model, "extractParamMap") else {}
    return {"kind": type(model).__name__, "settings": params}


def _histogram_tree(t: Tree, node: int, model: HistogramBoostModel) -> dict:
    s = t.splits.get(node)
    if s is None:
        return {"rows": int(t.stats[node][0]), "value": float(t.values[node])}
    out: dict = {"rows": int(t.stats[node][0]), "feature": model.binning.names[s.feature]}
    out |= {"cut": s.cut} if s.left is None else {"levels": s.left.tolist()}
    return out | {"left": _histogram_tree(t, 2 * node + 1, model), "right": _histogram_tree(t, 2 * node + 2, model)}


def _by_tree(spark, model) -> dict[int, dict[int, dict]]:
    return {i: {n["id"]: n for n in nodes} for i, nodes in _nodes_of(spark, model).items()}


def _tree(spark, model, names, values: dict[float, float] | None = None) -> dict:
    nodes = next(iter(_by_tree(spark, model).values()))
    return _nested(nodes, min(nodes), names, values)


def _nested(nodes: dict[int, dict], at: int, names, values=None) -> dict:
    n = nodes[at]
    if n["leftChild"] < 0:
        return {"prediction": float(n["prediction"])} if values is None else {"value": float(values.get(float(at), 0.0))}
    s = n["split"]
    i, cut = s["featureIndex"], list(s["leftCategoriesOrThreshold"])
    levels = s["numCategories"] is not None and s["numCategories"] >= 0
    return {"feature": names[i] if names and i < len(names) else f"f{i}",
            **({"levels": [int(c) for c in cut]} if levels else {"threshold": float(cut[0])}),
            "left": _nested(nodes, n["leftChild"], names, values), "right": _nested(nodes, n["rightChild"], names, values)}
