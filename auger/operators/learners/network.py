"""H9: feed-forward network with rectifier units and ADADELTA, trained by model averaging.

Each epoch is one Spark pass: the current weights are broadcast; every task trains a copy on its
own rows (mini-batches, ReLU hidden layers, softmax output, cross-entropy, ADADELTA updates with
``rho`` and ``eps``) and emits its weights with its row count, in pieces; sums in two steps over the tasks form the
row-weighted average (weights and ADADELTA's running averages alike), which starts the next
epoch. This is the data-parallel scheme of
map-reduce deep learning (local training, global averaging); Spark partitions the rows and does
the averaging, numpy runs the per-task arithmetic. Scoring is a forward pass per Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.operators.learners.builtin import NET_SEED
from auger.operators.splits import persisted
from auger.operators.sums import PIECES, piece_rows, summed


def _shapes(layers: list[int]) -> list[tuple[int, int]]:
    return [(layers[i], layers[i + 1]) for i in range(len(layers) - 1)]


def _unpack(theta: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, o = [], 0
    for a, b in _shapes(layers):
        W = theta[o:o + a * b].reshape(a, b)
        o += a * b
        out.append((W, theta[o:o + b]))
        o += b
    return out


def n_params(layers: list[int]) -> int:
    return sum(a * b + b for a, b in _shapes(layers))


def _forward(params, X):
    acts = [X]
    h = X
    for i, (W, b) in enumerate(params):
        z = h @ W + b
        if i < len(params) - 1:
            h = np.maximum(z, 0.0)
        else:
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            h = e / e.sum(axis=1, keepdims=True)
        acts.append(h)
    return acts


def _grad(params, X, Y):
    """Mean cross-entropy gradient over the mini-batch, flattened like ``theta``."""
    acts = _forward(params, X)
    delta = (acts[-1] - Y) / len(X)
    grads = []
    for i in range(len(params) - 1, -1, -1):
        W, _ = params[i]
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i > 0:
            delta = (delta @ W.T) * (acts[i] > 0)
    grads.reverse()
    return np.concatenate([np.concatenate([g.ravel(), gb]) for g, gb in grads])


@dataclass
class AveragedNetwork:
    layers: list[int]
    theta: np.ndarray
    features: str = "features"
    history: list[float] = field(default_factory=list)
    valid_history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        k = self.layers[-1]
        theta, layers = self.theta, self.layers
        bc = df.sparkSession.sparkContext.broadcast(theta)
        fields = [f"p{i}" for i in range(k)] + [prediction]

        @F.pandas_udf(", ".join(f"`{c}` double" for c in fields))
        def score(xs: pd.Series) -> pd.DataFrame:
            params = _unpack(bc.value, layers)
            P = _forward(params, np.stack(xs.to_numpy()))[-1] if len(xs) else np.zeros((0, k))
            return pd.DataFrame(np.column_stack([P, P.argmax(axis=1)]), columns=fields)

        # only the inputs go through Python; the other columns, vectors among them, stay where they are
        out = df.withColumn("_out", score(vector_to_array(F.col(self.features))))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_out").getField(c).alias(c) for c in fields])


def weight_importances(net: AveragedNetwork) -> np.ndarray:
    """the share of each input in the outputs by absolute weights: a unit's weights are divided by their
    sum, the matrices multiplied from input to output, the rows summed and scaled to a sum of one."""
    share = None
    for W, _ in _unpack(net.theta, net.layers):
        W = np.abs(W)
        W = W / np.where(W.sum(axis=0) > 0, W.sum(axis=0), 1.0)
        share = W if share is None else share @ W
    total = share.sum(axis=1)
    return total / total.sum() if total.sum() > 0 else total


def fit_network_averaged(df: DataFrame, n_in: int, n_classes: int, hidden: tuple[int, ...] = (200, 200),
                         epochs: int = 10, features: str = "features", label: str = "label",
                         rho: float = 0.99, eps: float = 1e-8, batch: int = 32,
                         seed: int = NET_SEED, valid: DataFrame | None = None,
                         rows_per_task: int = 4096, start: np.ndarray | None = None) -> AveragedNetwork:
    """Fit on a vector column and class indexes 0..K-1.

    The rows are dealt by their own hash to as many local learners as have about ``rows_per_task`` rows
    each, in an order of that hash, so the result does not depend on how the table lay in partitions.

    ``start`` gives the first weights, layer by layer: a matrix by rows, then the biases.

    With ``valid``, the weights after each epoch are scored on those rows (one pass) and the
    epoch with the best accuracy is kept ("keep the best model"); ``valid_history`` records it.
    """
    layers = [n_in, *hidden, n_classes]
    size = n_params(layers)
    rng = np.random.default_rng(seed % (2 ** 63))
    theta = np.array(start, dtype=float) if start is not None else np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6.0 / (a + b)), np.zeros(b)])
                            for a, b in _shapes(layers)])
    base = df.select(vector_to_array(F.col(features)).alias("_x"), F.col(label).cast("int").alias("_y"),
                     F.lit(False).alias("_val"))
    if valid is not None:  # validation rows ride along in the training pass (scored, not trained on)
        base = base.unionByName(valid.select(vector_to_array(F.col(features)).alias("_x"),
                                             F.col(label).cast("int").alias("_y"), F.lit(True).alias("_val")))
    parts = max(1, -(-base.count() // rows_per_task))
    base = (base.withColumn("_h", F.xxhash64("_x", "_y", "_val")).repartition(parts, "_h")
            .sortWithinPartitions("_h", "_x", "_y").drop("_h"))
    net = AveragedNetwork(layers, theta, features)
    # ADADELTA's running averages (E[g^2], E[dx^2]) are averaged and carried across epochs too
    state = np.concatenate([theta, np.zeros(size), np.zeros(size)])
    best: tuple[float, np.ndarray] | None = None

    def keep(acc: float, th: np.ndarray) -> None:
        nonlocal best
        net.valid_history.append(acc)
        if best is None or acc > best[0]:
            best = (acc, th.copy())

    with persisted(base):
        for ep in range(epochs):
            bc = df.sparkSession.sparkContext.broadcast(state)

            def train(batches, ep=ep):
                st = bc.value
                start_params = _unpack(st[:size], layers)
                th, eg, ex = st[:size].copy(), st[size:2 * size].copy(), st[2 * size:].copy()
                n, loss, vc, vn = 0, 0.0, 0.0, 0.0
                r = np.random.default_rng(seed % 1000003 + ep)
                for pdf in batches:
                    if len(pdf) == 0:
                        continue
                    is_val = pdf["_val"].to_numpy(dtype=bool)
                    if is_val.any():  # accuracy of the weights this epoch started from
                        Xv = np.stack(pdf["_x"].to_numpy()[is_val])
                        yv = pdf["_y"].to_numpy()[is_val]
                        vc += float((_forward(start_params, Xv)[-1].argmax(axis=1) == yv).sum())
                        vn += float(len(yv))
                    if is_val.all():
                        continue
                    X = np.stack(pdf["_x"].to_numpy()[~is_val])
                    y = pdf["_y"].to_numpy()[~is_val]
                    order = r.permutation(len(X))
                    for s in range(0, len(X), batch):
                        idx = order[s:s + batch]
                        Y = np.zeros((len(idx), n_classes))
                        Y[np.arange(len(idx)), y[idx]] = 1.0
                        params = _unpack(th, layers)
                        g = _grad(params, X[idx], Y)
                        eg = rho * eg + (1 - rho) * g * g
                        dx = -np.sqrt(ex + eps) / np.sqrt(eg + eps) * g
                        ex = rho * ex + (1 - rho) * dx * dx
                        th = th + dx
                    P = _forward(_unpack(th, layers), X)[-1]
                    loss += float(-np.log(np.clip(P[np.arange(len(X)), y], 1e-15, None)).sum())
                    n += len(X)
                w = np.concatenate([th, eg, ex]) * n if n else np.zeros(3 * size)
                yield from piece_rows(np.append(w, [n, loss, vc, vn]))

            total = summed(base.mapInPandas(train, PIECES), 3 * size + 4)
            bc.unpersist()
            n, loss, vc, vn = total[3 * size:]
            if not n:
                break
            if valid is not None and ep > 0 and vn:
                keep(vc / vn, net.theta)  # the previous epoch's weights
            state = total[:3 * size] / n
            net.theta = state[:size]
            net.history.append(loss / n)
    if valid is not None and net.history:  # the last epoch's weights: one scoring pass
        acc = net.transform(valid).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        keep(acc or 0.0, net.theta)
    if best is not None:
        net.theta = best[1]
    return net
