"""Whitening of embeddings with a weighted covariance over their distinct vectors.

Entries c become integers x = floor(1024 c) + 100000 (entries beyond +-2^52 / 1024 count as those).

1. Rows with equal x are one vector with a multiplicity. It is its fit weight, or each weighs one.
2. The sums of x per dimension are exact (two longs a number), and with them the mean.
3. Each task centres its distinct vectors and multiplies once, ``(w X)' X``; the rows of the matrices are
   summed over tasks in two steps. Only the d x d covariance is on the driver, for its eigenvectors.
4. Every distinct vector is whitened once and joined back to its rows. Vectors that hold at least a
   1024th of the rows, at most 1024, are joined by broadcast, so no frequent vector is a key of a shuffle.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors of each length are a
space of their own with its own fit; an empty vector has no components. A component without variance (of
equal or linearly dependent vectors) has null ``whitened`` and is not part of ``identity_error``. Repeated
rows and null ids each give their rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.operators.sums import vector_sums
from auger.session import write_scratch

COMPONENTS = 8
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 52)
HOT = 1024
KEY = ["dim", "k1", "k2"]
LOW = 26  # bits of the low part of an entry


@dataclass
class Space:
    """The fit of vectors of one length: ``n`` rows with sums ``S`` (exact), the whole and the broken part of
    the mean, ``axes`` (columns) with the eigenvalues ``values``, and the trace."""

    n: int
    sums: list[int]
    whole: np.ndarray
    part: np.ndarray
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0


def _entries(vectors: pa.Array, dim: int) -> np.ndarray:
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(np.clip(c * SCALE, -LIMIT, LIMIT)).astype(np.int64) + SHIFT


def _by_dim(batches):
    """(dim, batch of that dim) with at most about a million entries."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == d)))
            step = max(1, 1_000_000 // int(d))
            for at in range(0, len(part), step):
                yield int(d), part.slice(at, step)


def distinct_vectors(rows: DataFrame, vector: str, weights: str = "counts") -> tuple[DataFrame, DataFrame]:
    """Written tables: of all usable rows their columns but ``vector`` and the key of their x, and of the
    distinct x (``vec``, one of those with it) ``copies`` and the fit weight ``w``."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))))
    keyed = (rows.where(c.isNotNull() & (F.size(c) > 0) & fine)
             .withColumns({"dim": F.size(c), "k1": F.xxhash64(x), "k2": F.xxhash64(F.lit(1), x)}))
    same = keyed.groupBy(*KEY).agg(F.any_value(vector).alias("vec"), F.count(F.lit(1)).alias("copies"))
    same = same.withColumn("w", F.col("copies") if weights == "counts" else F.lit(1).cast("long"))
    return write_scratch(keyed.drop(vector), "whiten-rows"), write_scratch(same, "whiten-distinct")


def _means(same: DataFrame) -> dict[int, Space]:
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for d, part in _by_dim(batches):
            x, w = _entries(part.column("vec"), d), part.column("w").to_numpy()
            if d not in sums:
                sums[d] = np.zeros((3, d), dtype=np.int64)
            sums[d] += np.stack((w @ (x >> LOW), w @ (x & (1 << LOW) - 1), np.full(d, w.sum())))
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(d, d, dtype=np.int32), "at": np.arange(d, dtype=np.int32),
                                              "high": s[0], "low": s[1], "n": s[2]})

    parts = same.select("dim", "vec", "w").mapInArrow(run, "dim int, at int, high long, low long, n long")
    found: dict[int, list] = {}
    for r in parts.groupBy("dim", "at").agg(*[F.sum(k).alias(k) for k in ("high", "low", "n")]).orderBy("dim", "at").collect():
        found.setdefault(r["dim"], []).append(((r["high"] << LOW) + r["low"], r["n"]))
    spaces = {}
    for d, sums in found.items():
        n, total = sums[0][1], [s for s, _ in sums]
        whole = [s // n for s in total]
        part = [(s - m * n) / n for s, m in zip(total, whole)]
        spaces[d] = Space(n, total, np.array(whole, dtype=np.int64), np.array(part))
    return spaces


def fit(same: DataFrame, k: int = COMPONENTS) -> dict[int, Space]:
    """The spaces of a table of distinct vectors (``dim, vec, w``), by length, with up to ``k`` components."""
    spaces = _means(same)
    shared = same.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        grams: dict[int, np.ndarray] = {}
        for d, part in _by_dim(batches):
            s = shared.value[d]
            x = (_entries(part.column("vec"), d) - s.whole) - s.part
            grams[d] = grams.get(d, 0) + (x * part.column("w").to_numpy()[:, None]).T @ x
        for d, g in grams.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(d, d, dtype=np.int32), "at": np.arange(d, dtype=np.int32),
                                              "values": pa.array(list(g))})

    parts = same.select("dim", "vec", "w").mapInArrow(run, "dim int, at int, values array<double>")
    rows: dict[int, list] = {}
    for r in vector_sums(parts, ["dim", "at"]).orderBy("dim", "at").toLocalIterator():
        rows.setdefault(r["dim"], []).append(r["values"])
    for d, g in rows.items():
        s = spaces[d]
        cov = np.array(g) / s.n
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        s.trace, s.values, s.axes = float(np.trace(cov)), values, axes
    return spaces


def _deviations(x: np.ndarray, s: Space) -> list:
    """Sums of (n x - S)^2, exact; None beyond 38 digits."""
    size = s.n * np.abs(x.astype(np.float64)).max(axis=1) + max(map(abs, s.sums))
    small = size * size * (4 * x.shape[1]) < 2.0 ** 62
    out: list = [None] * len(x)
    if small.any():
        v = x[small] * s.n - np.array(s.sums, dtype=np.int64)
        for i, q in zip(np.flatnonzero(small).tolist(), (v * v).sum(axis=1).tolist()):
            out[i] = q
    for i in np.flatnonzero(~small).tolist():
        q = sum((s.n * e - t) ** 2 for e, t in zip(x[i].tolist(), s.sums))
        out[i] = q if q < 10 ** 38 else None
    return out


def _with_variance(s: Space, d: int) -> np.ndarray:
    return s.values > 8 * d * np.finfo(float).eps * s.trace


def whiten_distinct(same: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """``KEY, copies, w, deviation`` (decimal) and ``z``, the whitened components, for each distinct vector."""
    shared = same.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        for d, part in _by_dim(batches):
            s = shared.value[d]
            x = _entries(part.column("vec"), d)
            live = _with_variance(s, d)
            z = (((x - s.whole) - s.part) @ s.axes) / np.sqrt(np.where(live, s.values, 1))
            z = [[v if ok else None for v, ok in zip(row, live)] for row in z.tolist()]
            dev = [None if q is None else Decimal(q) for q in _deviations(x, s)]
            yield pa.RecordBatch.from_pydict(
                {k: part.column(k) for k in (*KEY, "copies", "w")}
                | {"deviation": pa.array(dev, pa.decimal128(38, 0)), "z": pa.array(z, pa.list_(pa.float64()))})

    return same.mapInArrow(run, "dim int, k1 long, k2 long, copies long, w long, deviation decimal(38,0), z array<double>")


def identity_errors(white: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Per length the largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not spaces:
        return {}
    k = max(len(s.values) for s in spaces.values())
    z = [F.col("z")[i] for i in range(k)]
    means = {r["dim"]: r for r in white.groupBy("dim").agg(
        *[(F.sum(F.get("z", F.lit(i)) * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(k)]).collect()}
    errors = {}
    for d, s in spaces.items():
        live = [i for i in range(len(s.values)) if _with_variance(s, d)[i]]
        pairs = [(i, j) for i in live for j in live if i <= j]
        if not pairs:
            errors[d] = 0.0
            continue
        centred = {i: z[i] - F.lit(means[d][f"m{i}"]) for i in live}
        sums = white.where(F.col("dim") == d).agg(
            *[F.sum(centred[i] * centred[j] * F.col("w")).alias(f"c{i}_{j}") for i, j in pairs]).first()
        errors[d] = max(abs(sums[f"c{i}_{j}"] / s.n - (i == j)) for i, j in pairs)
    return errors


def whiten(rows: DataFrame, vector: str, weights: str = "counts", k: int = COMPONENTS) -> DataFrame:
    """For each usable row and component up to ``k``: the row's other columns, ``component`` (from 1), ``n`` (rows
    of its space), ``deviation`` (decimal: sum of (n x - S)^2), ``whitened``, ``explained``, ``identity_error``.

    ``weights``: "counts" fits all rows, "one" each distinct vector once."""
    keyed, same = distinct_vectors(rows, vector, weights)
    spaces = fit(same, k)
    white = write_scratch(whiten_distinct(same, spaces), "whitened")
    errors = identity_errors(white, spaces)
    facts = rows.sparkSession.createDataFrame(
        [(d, i + 1, s.n, float(e / s.trace) if s.trace else 0.0, float(errors[d]))
         for d, s in spaces.items() for i, e in enumerate(s.values.tolist())],
        "dim int, component int, n long, explained double, identity_error double")
    total = keyed.count()
    hot = F.col("copies") >= max(2, math.ceil(total / HOT))  # at most HOT vectors
    z = white.select(*KEY, "copies", "deviation", "z")
    often = F.broadcast(z.where(hot).drop("copies"))
    joined = (keyed.join(often, KEY)
              .unionByName(keyed.join(F.broadcast(z.where(hot).select(*KEY)), KEY, "left_anti")
                           .join(z.where(~hot).drop("copies"), KEY)))
    each = joined.select("*", F.posexplode("z").alias("_at", "whitened")).withColumn("component", F.col("_at") + 1)
    return each.join(F.broadcast(facts), ["dim", "component"]).drop(*KEY, "z", "_at")
