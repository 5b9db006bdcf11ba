"""Choose a learner by name; users register their own.

A factory takes keyword settings and returns an object with ``fit(df) -> model`` whose model
has ``transform(df)``: every Spark ML estimator qualifies, and so do the aggregate learners
here. Names of the original's three-way switch (``GLM``, ``GBM``, ``DEEP_LEARNING``) map to the
matching learner (each to its own; the original's factory lost two of them).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.operators.learners import builtin
from auger.operators.learners.boosting import fit_boosting
from auger.operators.learners.glm import fit_glm
from auger.operators.learners.network import fit_network_averaged
from auger.operators.learners.sgd import sgd_linear_vector


@dataclass
class _SgdEstimator:
    loss: str
    n_features: int
    features: str = "features"
    label: str = "label"
    iterations: int = 5
    step: float = 1.0
    reg: float = 0.0

    def fit(self, df: DataFrame):
        m = sgd_linear_vector(df, self.features, self.label, self.loss, self.iterations, self.step, self.reg)
        return _SgdModel(m, self.features, self.n_features)


@dataclass
class _SgdModel:
    inner: object
    features: str
    n_features: int

    def transform(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(F.col(self.features))
        return self.inner.transform(df, [arr[j] for j in range(self.n_features)])


@dataclass
class _BoostEstimator:
    features: str = "features"
    label: str = "label"
    n_classes: int | None = None
    rounds: int = 5
    depth: int = 5
    bins: int = 20
    rate: float = 1.0

    def fit(self, df: DataFrame):
        return fit_boosting(df, self.features, self.label, self.n_classes, self.rounds, self.depth,
                            self.bins, self.rate)


@dataclass
class _GlmEstimator:
    features: str = "features"
    label: str = "label"
    alpha: float = builtin.GLM_ALPHA
    lam: float = builtin.GLM_LAMBDA
    standardize: bool = True
    max_iter: int = 50

    def fit(self, df: DataFrame):
        return fit_glm(df, self.features, self.label, self.alpha, self.lam, self.standardize, self.max_iter)


@dataclass
class _AveragedNetworkEstimator:
    n_in: int
    n_classes: int
    features: str = "features"
    label: str = "label"
    hidden: tuple[int, ...] = builtin.NET_HIDDEN
    epochs: int = builtin.NET_EPOCHS

    def fit(self, df: DataFrame):
        return fit_network_averaged(df, self.n_in, self.n_classes, self.hidden, self.epochs, self.features,
                                    self.label)


_REGISTRY: dict[str, Callable[..., object]] = {}


class _HistogramBoostEstimator:
    """Boosting on the columns themselves: text columns are split by level sets, however many levels. Without
    columns it takes the slots of the feature vector."""

    def __init__(self, numeric=None, categorical=(), n_features=None, features="features", **settings):
        self.columns = None if numeric is None else (list(numeric), list(categorical))
        self.n_features, self.features, self.settings = n_features, features, settings

    def fit(self, df):
        from auger.operators.learners.histogram_trees import fit_histogram_boosting
        if self.columns:
            return fit_histogram_boosting(df, *self.columns, **self.settings)
        slots = _Slots(self.n_features, self.features)
        return _SlotModel(fit_histogram_boosting(slots.add(df), slots.names, **self.settings), slots)


@dataclass
class _Slots:
    n: int
    features: str

    @property
    def names(self) -> list[str]:
        return [f"_slot{j}" for j in range(self.n)]

    def add(self, df):
        arr = vector_to_array(F.col(self.features))
        return df.withColumns({c: arr[j] for j, c in enumerate(self.names)})


@dataclass
class _SlotModel:
    inner: object
    slots: _Slots

    def transform(self, df):
        return self.inner.transform(self.slots.add(df)).drop(*self.slots.names)


def register(name: str, factory: Callable[..., object]) -> None:
    _REGISTRY[name.lower()] = factory


def make(name: str, **settings):
    try:
        return _REGISTRY[name.lower()](**settings)
    except KeyError:
        raise KeyError(f"unknown learner {name!r}; known: {sorted(_REGISTRY)}") from None


def accepts(name: str, setting: str) -> bool:
    """Whether the learner registered as ``name`` takes the keyword ``setting``."""
    import inspect
    f = _REGISTRY[name.lower()]
    try:
        params = inspect.signature(f).parameters
    except (TypeError, ValueError):
        return False
    return setting in params


def names() -> list[str]:
    return sorted(_REGISTRY)


register("decision_tree", builtin.decision_tree)
register("naive_bayes", builtin.naive_bayes)
register("logistic_sgd", lambda n_features, **kw: _SgdEstimator("logistic", n_features, **kw))
register("svm_sgd", lambda n_features, **kw: _SgdEstimator("hinge", n_features, **{"reg": 0.01, **kw}))
register("linear_svc", builtin.linear_svc)
register("glm", lambda **kw: _GlmEstimator(**kw))
register("glm_lbfgs", builtin.glm)
register("glm_cv", builtin.glm_cv)
register("gbm", builtin.gbm)
register("gbm_newton", lambda n_classes=None, **kw: _BoostEstimator(n_classes=n_classes, **kw))
register("gbm_histogram", lambda numeric=None, categorical=(), n_features=None, **kw: _HistogramBoostEstimator(numeric, categorical, n_features, **kw))
register("deep_learning", lambda n_in, n_classes, **kw: _AveragedNetworkEstimator(n_in, n_classes, **kw))
register("perceptron", lambda n_in, n_classes, **kw: builtin.network(n_in, n_classes, **kw))
# the original's enum names
register("GLM", lambda **kw: _GlmEstimator(**kw))
register("GBM", builtin.gbm)
register("DEEP_LEARNING", lambda n_in, n_classes, **kw: _AveragedNetworkEstimator(n_in, n_classes, **kw))
