"""the full training report - split, fit by learner name, score, metrics, importances.

The scored test table is checkpointed once to the shared folder; every metric is then one
aggregate over it, and the report is a small ``(section, key, value)`` table. Predictions stay
a distributed DataFrame for the sinks (A9/A10) - nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auger.operators import metrics as M
from auger.operators.learners.registry import accepts, make
from auger.operators.scoring import importances, permutation_importance, score
from auger.operators.splits import hash_split, split
from auger.sources.config import JobConfig, LabelSpec
from auger.session import materialize


def _kv(df: DataFrame, section: str) -> DataFrame:
    """One-row metric frame -> (section, key, value) rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
        for c in df.columns])).alias("kv")).select("kv.*")


def train_and_report(spark: SparkSession, df: DataFrame, algorithm: str, features: str = "features",
                     label: str = "label", key: str | None = None, n_classes: int = 2, positive: float = 1.0,
                     seed: int = 42, threshold: str | float | None = None, **settings) -> dict[str, DataFrame]:
    """Split, fit the named learner, score the held-out rows, and build the report tables.

    ``threshold="max_f1"`` labels two-class rows positive at the score that maximises F1 on the
    training rows (the convention of the original's boosting reports); a number fixes it; the
    default keeps the learner's own decision.
    """
    if key:
        train, test = hash_split(df, key)
    else:
        train, test = split(df, 0.8, seed)
    if algorithm.lower() == "gbm" and n_classes > 2:
        algorithm = "gbm_newton"  # the built-in booster takes two classes only
    if accepts(algorithm, "n_classes") and "n_classes" not in settings:
        settings = {**settings, "n_classes": n_classes}
    for name in ("n_in", "n_features"):
        if accepts(algorithm, name) and name not in settings:
            first = train.select(features).first()  # one row: its length is that of all
            if first is None:
                raise ValueError("no training rows")
            settings = {**settings, name: len(first[0])}
    est = make(algorithm, **settings)
    model = est.fit(train)
    scored = score(model, test, n_classes)
    thr = None
    prob = f"p{int(positive)}"  # the score of the positive class, whichever index it has
    if threshold is not None and n_classes == 2 and prob in scored.columns:
        if threshold == "max_f1":
            best_tr = M.best_threshold(M.threshold_sweep(score(model, train, n_classes), prob, label, positive))
            thr = best_tr.first()["thr"]  # one row
        else:
            thr = float(threshold)
        scored = scored.withColumn("prediction", F.when(F.col(prob) >= thr, F.lit(positive))
                                   .otherwise(F.lit(1.0 - positive)))
    scored = scored.transform(materialize)
    two = n_classes == 2 and prob in scored.columns
    # one pass for the scalar metrics, one shared score table for AUC and the threshold sweep
    parts = [_kv(M.summary(scored, "prediction", label, prob if two else None, positive), "error")]
    if two:
        g = M.score_table(scored, prob, label, positive)
        parts.append(_kv(M.auc(table=g), "auc"))
        best = M.best_threshold(M.threshold_sweep(table=g))
        parts.append(_kv(best.select("thr", "f1", "accuracy"), "best_threshold"))
        if hasattr(model, "coefficients"):
            y = F.when(F.col(label) == F.lit(positive), 1.0).otherwise(0.0)
            parts.append(_kv(M.glm_validation(scored.withColumn("_y", y), prob, "_y", len(model.coefficients) + 1), "glm"))
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    out = {"metrics": metrics, "confusion": M.confusion(scored, "prediction", label), "predictions": scored,
           "model": model, "threshold": thr, "algorithm": algorithm}
    if hasattr(model, "featureImportances"):
        out["importances"] = importances(spark, model)
    elif algorithm.lower() in ("deep_learning", "perceptron"):
        out["importances"] = permutation_importance(spark, model, test, features, label)
    return out


def train_from_config(spark: SparkSession, cfg: JobConfig, algorithm: str, **settings) -> dict[str, DataFrame]:
    """A8 -> A1 -> B3/B4 -> B9 -> B11 -> F7: the configured training job end to end.

    Numeric columns are cleaned and cast to double, missing ones take the training rows' mean; columns named in ``cfg.categorical`` are
    cleaned and level-indexed in text order (indexes fitted on training rows, unseen levels get
    one extra index) and enter the feature vector as nominal attributes, so tree learners split
    them by level sets. Tree learners need ``max_bins`` at least the number of levels.

    ``input`` in the report (also a section of its metrics) counts the rows read, those that lost a field
    (missing, left over or no number) and the fields lost; ``algorithm`` is the learner used.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Imputer, StringIndexer

    from auger.functions.cleaning import BAD_FIELDS_COL, clean_col, encode_frame
    from auger.functions.encoding import assembler, index_label
    from auger.sources.models import PreparedModel
    from auger.sources.tables import RAGGED, add_ragged, read_config_table

    raw = read_config_table(spark, cfg, RAGGED)
    resp = (cfg.response if isinstance(cfg.response, LabelSpec) else LabelSpec("name", cfg.response)).resolve([c for c in raw.columns if c != RAGGED])
    if resp == "label":  # the name that the class index takes
        raw, resp = raw.withColumnRenamed("label", "_response"), "_response"
    cats = [c for c in cfg.categorical if c not in (resp, "label") and c not in cfg.ignored]
    nums = [c for c in raw.columns if c not in (resp, RAGGED) and c not in cfg.ignored and c not in cats]
    df = add_ragged(encode_frame(raw.withColumns({c: clean_col(c) for c in [resp, *cats]}), nums))
    lost = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(BAD_FIELDS_COL) > 0).alias("bad_rows"),
                  F.coalesce(F.sum(BAD_FIELDS_COL), F.lit(0)).alias("bad_fields"))
    key = cfg.key
    if not key:  # without a key the split goes by a hash of the raw row: repeatable, and known before any fit
        key = "_row"
        df = df.withColumn(key, F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))
    fit_part = hash_split(df, key)[0]
    idx = index_label(fit_part, resp, "label", handle_invalid="keep")  # levels from training rows
    df = idx.transform(df)
    stages = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[c + "_lvl" for c in cats],
                                    stringOrderType="alphabetAsc", handleInvalid="keep").fit(fit_part))
    if nums:  # what a row lacks counts as the mean of the training rows, in training and in scoring
        stages.append(Imputer(inputCols=nums, outputCols=[c + "_num" for c in nums]).fit(fit_part))
    stages.append(assembler([*[c + "_num" for c in nums], *[c + "_lvl" for c in cats]], "features"))
    prep = PipelineModel(stages=stages)
    if accepts(algorithm, "numeric"):  # learners that take the columns themselves
        settings = {"numeric": nums, "categorical": cats, **settings}
    positive = 1.0
    if cfg.positive_label is not None:
        if cfg.positive_label not in idx.labels:
            raise ValueError(f"positive label {cfg.positive_label!r} not in {list(idx.labels)}")
        positive = float(list(idx.labels).index(cfg.positive_label))
    rep = train_and_report(spark, prep.transform(df), algorithm, key=key, n_classes=max(2, len(idx.labels)), positive=positive, **settings)
    # scores raw cleaned rows: one pipeline, or the preparation and a model of this package
    rep["pipeline"] = (PipelineModel(stages=[*stages, rep["model"]]) if hasattr(rep["model"], "write")
                       else PreparedModel(prep, rep["model"]))
    rep["n_classes"] = max(2, len(idx.labels))
    rep["labels"] = list(idx.labels)
    rep["input"] = lost
    rep["metrics"] = rep["metrics"].unionByName(_kv(lost, "input"))
    return rep
