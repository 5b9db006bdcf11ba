"""H1, H7, H9 (and alternatives for H4, H5): learners Spark ML already implements, with the
original jobs' settings.

Each factory returns an unfitted estimator; fitting is distributed by Spark ML (histogram
trees over ``maxBins`` bins, block L-BFGS for the network). ``glm``/``glm_cv`` here are the
quasi-Newton (OWL-QN) alternative; the GLM used by the queries and the registry's ``GLM`` is the
IRLS one in ``glm.py``.
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

# The learner settings of the original jobs.
TREE_DEPTH, TREE_BINS = 5, 32
GBM_TREES, GBM_DEPTH, GBM_BINS, GBM_RATE, GBM_MIN_ROWS = 10, 5, 20, 1.0, 1
GLM_ALPHA, GLM_LAMBDA, GLM_FOLDS = 0.5, 1e-5, 10
NET_HIDDEN, NET_EPOCHS, NET_SEED = (200, 200), 10, 113974111632823084
NB_SMOOTHING = 1.0


def decision_tree(features: str = "features", label: str = "label", max_depth: int = TREE_DEPTH,
                  max_bins: int = TREE_BINS, seed: int = 42, **kw) -> DecisionTreeClassifier:
    """H1: gini tree, depth 5, 32 bins."""
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity="gini",
                                  maxDepth=max_depth, maxBins=max_bins, seed=seed, **kw)


def naive_bayes(features: str = "features", label: str = "label", smoothing: float = NB_SMOOTHING) -> NaiveBayes:
    """H2 as a pipeline stage (the aggregate form is in ``bayes.py``)."""
    return NaiveBayes(featuresCol=features, labelCol=label, smoothing=smoothing, modelType="multinomial")


def glm(features: str = "features", label: str = "label", alpha: float = GLM_ALPHA, lam: float = GLM_LAMBDA,
        standardization: bool = True, max_iter: int = 100) -> LogisticRegression:
    """H5/H6: binomial GLM, logit link, elastic net."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="binomial",
                              elasticNetParam=alpha, regParam=lam, standardization=standardization,
                              maxIter=max_iter)


def glm_cv(features: str = "features", label: str = "label", folds: int = GLM_FOLDS,
           fold_col: str | None = None, parallelism: int = 4, **kw) -> CrossValidator:
    """H5 with k-fold cross-validation (AUC per fold; ``fold_col`` makes folds repeatable)."""
    est = glm(features, label, **kw)
    grid = ParamGridBuilder().addGrid(est.regParam, [est.getRegParam()]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction"))
    if fold_col:
        cv.setFoldCol(fold_col)
    return cv


def gbm(features: str = "features", label: str = "label", trees: int = GBM_TREES, depth: int = GBM_DEPTH,
        bins: int = GBM_BINS, rate: float = GBM_RATE, min_rows: int = GBM_MIN_ROWS, seed: int = 42) -> GBTClassifier:
    """H7: two-class gradient boosting (Spark's logistic loss with +-1 labels)."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, maxBins=bins,
                         stepSize=rate, minInstancesPerNode=min_rows, seed=seed)


def network(n_in: int, n_classes: int, hidden: tuple[int, ...] = NET_HIDDEN, epochs: int = NET_EPOCHS,
            features: str = "features", label: str = "label", seed: int = NET_SEED,
            block_size: int = 128) -> MultilayerPerceptronClassifier:
    """H9: feed-forward network (sigmoid hidden units, softmax output, L-BFGS)."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_in, *hidden, n_classes], maxIter=epochs,
                                          seed=seed % (2 ** 63), blockSize=block_size)


def linear_svc(features: str = "features", label: str = "label", reg: float = 0.01, max_iter: int = 100) -> LinearSVC:
    """H4 alternative: Spark's OWL-QN linear SVM (with intercept; not the SGD trainer)."""
    return LinearSVC(featuresCol=features, labelCol=label, regParam=reg, maxIter=max_iter)


def fit_network_keep_best(train, valid, n_in: int, n_classes: int, hidden: tuple[int, ...] = NET_HIDDEN,
                          epochs: int = NET_EPOCHS, step: int = 1, features: str = "features",
                          label: str = "label", seed: int = NET_SEED):
    """H9 with "keep the best model": train in chunks of ``step`` iterations, each chunk starting
    from the previous weights, score the validation rows after each chunk and keep the model with
    the best validation accuracy. Returns (best model, [(iterations, accuracy), ...])."""
    from pyspark.sql import functions as F

    best, best_acc, weights, hist = None, -1.0, None, []
    for done in range(step, epochs + 1, step):
        est = network(n_in, n_classes, hidden, step, features, label, seed)
        if weights is not None:
            est.setInitialWeights(weights)
        m = est.fit(train)
        weights = m.weights
        acc = (m.transform(valid).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")))
               .first()[0] or 0.0)
        hist.append((done, acc))
        if acc > best_acc:
            best, best_acc = m, acc
    return best, hist
