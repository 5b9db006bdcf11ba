"""Exact k-nearest-neighbour join without all pairs, and the local outlier factor on top.

Plan:

0. Exact copies are collapsed first (``groupBy(vector)``, map-side combined), so a group of
   copies holding a third of the rows is one point for the search.
1. Pivots: a bounded, hash-chosen sample of the distinct vectors (size-checked, broadcast).
2. Every vector goes to its nearest pivot's cell; cells are cut into blocks of at most
   ``block`` vectors (``hash(id) % n_blocks(cell)``; by default it grows with the root of the
   number of vectors), so no group is larger than a block.
3. Phase 1, per block (``applyInPandas``): the k nearest inside the block. The k-th distance
   ``theta`` bounds the true k-th neighbour distance from above; so does
   ``d(q, pivot_c) + radius_c`` for any cell holding more than k vectors.
4. Phase 2: a vector is routed to another cell only if the cell's ball bound
   ``d(q, p_c) - radius_c`` and Voronoi bound ``(d(q,p_c)^2 - d(q,p_own)^2) / (2 d(p_own,p_c))``
   allow a point within ``theta``; then to those of the cell's blocks whose own ball bound allows
   it. Queries for one block are cut into chunks of at most ``block``; the block is copied to
   each chunk. A query goes with its ``theta``, so only what is that near leaves a task.
   In both phases distances come from products of matrices, and what may count is measured
   again by direct differences.
5. Per vector, candidates of both phases give the k nearest distinct vectors (all ties at the
   k-th distance kept). Members of copy groups are expanded back: every group's k+1 smallest ids
   are found by a salted tree reduction (bounded windows), and each point takes the k nearest
   of (own copies at distance 0, neighbour groups' smallest ids) ordered by (distance, id).

Only top-k candidates leave a task; no pair list is materialised. The result equals brute force
with ties broken by id. Joins that attach group results to the members of a hot copy group (and
LOF's joins on neighbour ids, which a hot group's smallest ids dominate) salt their hot keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.operators.joins import salted_join
from auger.session import materialize

BLOCK, MAX_BLOCK = 4096, 32_768  # points a task holds, twice; where no bound prunes, a point is routed to n / block blocks
MAX_BLOCK_BYTES = 32 << 20
CELLS = 1 << 21  # distances held at once
MAX_PIVOT_BYTES = 64 << 20
MAX_BLOCK_TABLE = 500_000
EPS = 1e-9
_SCHEMA = "i long, j long, d double"


def _dist_chunked(Q: np.ndarray, X: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Exact Euclidean distances |Q| x |X| by direct differences (no norm expansion)."""
    out = np.empty((len(Q), len(X)))
    for s in range(0, len(Q), chunk):
        diff = Q[s:s + chunk, None, :] - X[None, :, :]
        out[s:s + chunk] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"i": pd.Series([], dtype="int64"), "j": pd.Series([], dtype="int64"),
                         "d": pd.Series([], dtype="float64")})


def _topk(qids: np.ndarray, D: np.ndarray, xids: np.ndarray, k: int) -> pd.DataFrame:
    """Per query row of D: every candidate within the k-th smallest distance (ties kept),
    the query itself excluded."""
    rows_i, rows_j, rows_d = [], [], []
    for r in range(len(qids)):
        mask = xids != qids[r]
        dj, jj = D[r][mask], xids[mask]
        if len(dj) == 0:
            continue
        if len(dj) > k:
            kth = np.partition(dj, k - 1)[k - 1]
            sel = dj <= kth
            dj, jj = dj[sel], jj[sel]
        rows_i.append(np.full(len(dj), qids[r]))
        rows_j.append(jj)
        rows_d.append(dj)
    if not rows_i:
        return _empty()
    return pd.DataFrame({"i": np.concatenate(rows_i).astype("int64"), "j": np.concatenate(rows_j).astype("int64"),
                         "d": np.concatenate(rows_d)})


def _rowdist(A: np.ndarray, ia: np.ndarray, B: np.ndarray, ib: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """|A[ia] - B[ib]| row by row, in slices (bounded temporary memory)."""
    out = np.empty(len(ia))
    for s in range(0, len(ia), step):
        d = A[ia[s:s + step]] - B[ib[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _knn_block(qids: np.ndarray, Q: np.ndarray, xids: np.ndarray, X: np.ndarray, k: int,
               theta: np.ndarray | None = None) -> pd.DataFrame:
    """Top-k (ties kept) of each query among X, those above the query's ``theta`` left out.

    Squared distances come from one product of matrices per slice of queries (``CELLS`` of them at a time, never
    |Q| x |X|), about the middle of X. What lies within their rounding of the limit is measured again by direct
    differences, so distances and ties are those of :func:`_dist_chunked`."""
    if not len(Q) or not len(X):
        return _empty()
    mid = X.mean(axis=0)
    A, B = Q - mid, X - mid
    aa, bb = np.einsum("ij,ij->i", A, A), np.einsum("ij,ij->i", B, B)
    near_by = 8 * (X.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max()) + 1e-300
    if not np.isfinite(near_by).all():
        parts = [_topk(qids[s:s + 64], _dist_chunked(Q[s:s + 64], X), xids, k) for s in range(0, len(Q), 64)]
        return pd.concat(parts, ignore_index=True)
    most = np.finfo(float).max
    within = np.full(len(Q), np.inf) if theta is None else theta + EPS * (1 + theta)
    limit = within ** 2 + near_by
    by_id = np.argsort(xids, kind="stable")
    first, last = (np.searchsorted(xids, qids, side, sorter=by_id) for side in ("left", "right"))
    step, parts = max(1, CELLS // len(X)), []
    for s in range(0, len(Q), step):
        part = slice(s, s + step)
        D = A[part] @ B.T
        D *= -2.0
        D += bb
        D += aa[part, None]
        for r in np.flatnonzero(last[part] > first[part]):  # the query itself
            D[r, by_id[first[s + r]:last[s + r]]] = np.inf
        lim = limit[part].copy()
        free = np.flatnonzero(~np.isfinite(lim))
        if len(free) and k < len(X):
            lim[free] = np.partition(D[free], k - 1, axis=1)[:, k - 1] + 2 * near_by[part][free]
        rows, cols = np.nonzero(D <= np.minimum(lim, most)[:, None])
        d = _rowdist(Q[part], rows, X, cols)
        order = np.lexsort((d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        start = np.searchsorted(rows, np.arange(len(D) + 1))
        kth = np.full(len(D), np.inf)
        full = np.flatnonzero(np.diff(start) >= k)
        kth[full] = d[start[full] + k - 1]
        near = d <= np.minimum(kth, within[part])[rows]
        parts.append(pd.DataFrame({"i": qids[part][rows[near]], "j": xids[cols[near]], "d": d[near]}))
    return pd.concat(parts, ignore_index=True)


def _mat(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in series]) if len(series) else np.zeros((0, 0))


def _distinct_knn(pts: DataFrame, k: int, block: int | None, max_pivots: int, seed: int) -> DataFrame:
    """``(i, j, d)`` over distinct vectors ``(_id, _v)``: the k nearest, ties at the k-th kept.

    Two pivot levels: coarse cells (at most ``max_pivots``) for cheap pruning, and inside every
    cell sub-pivots sampled at rate 1/``block`` from the cell's own points, so sub-cells hold
    about ``block`` points wherever the data is dense. A block is a sub-cell, hash-split further
    only if it is still larger than ``block``.
    """
    spark = pts.sparkSession
    st = pts.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first()
    n = st["n"]
    if n <= 1:
        return spark.createDataFrame([], _SCHEMA)
    if st["lo"] != st["hi"] or st["lo"] < 1:
        raise ValueError(f"vectors must be non-null and of one length (found {st['lo']}..{st['hi']})")
    dims = int(st["hi"])
    max_subs = max(16, min(MAX_BLOCK_TABLE, MAX_PIVOT_BYTES // (dims * 8)))
    if block is None:  # grows with the root of n: so do the copies of a point
        block = max(BLOCK, min(MAX_BLOCK, 32 * math.isqrt(n), MAX_BLOCK_BYTES // (dims * 8)))
    block = max(block, math.ceil(n / max_subs), k + 1)
    n_piv = int(min(max_pivots, max(1, math.ceil(math.sqrt(n / block)))))
    piv = (pts.orderBy(F.xxhash64(F.col("_id"), F.lit(seed)), "_id").limit(n_piv)
           .select("_id", "_v").collect())  # bounded: n_piv vectors (distinct by construction)
    P = np.asarray([r["_v"] for r in piv], dtype=float)
    PP = _dist_chunked(P, P)
    bP = spark.sparkContext.broadcast(P)

    def assign_cell(batches):
        Pv = bP.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            D = _dist_chunked(_mat(pdf["_v"]), Pv)
            c = D.argmin(axis=1)
            yield pd.DataFrame({"_id": pdf["_id"].astype("int64"), "_v": pdf["_v"], "cell": c.astype("int32")})

    cells = pts.mapInPandas(assign_cell, "_id long, _v array<double>, cell int").transform(materialize)
    # sub-pivots: every level-1 pivot plus a hash sample at rate 1/block (density-adaptive)
    piv_ids = [int(r["_id"]) for r in piv]
    drawn = (cells.where((F.pmod(F.xxhash64("_id", F.lit(seed + 5)), F.lit(block)) == 0)
                         & ~F.col("_id").isin(piv_ids))
             .orderBy(F.xxhash64("_id", F.lit(seed + 6)), "_id").limit(max_subs)
             .select("_id", "_v", "cell").collect())  # bounded by max_subs
    # every cell keeps its own pivot as a sub-pivot (a pivot's nearest pivot is itself)
    sample = sorted([(c, pid, list(P[c])) for c, pid in enumerate(piv_ids)]
                    + [(r["cell"], r["_id"], r["_v"]) for r in drawn])
    S = np.asarray([v for _, _, v in sample], dtype=float)
    S_cell = np.array([c for c, _, _ in sample], dtype=np.int64)
    s_start = np.zeros(len(P), dtype=np.int64)
    s_cnt = np.bincount(S_cell, minlength=len(P)).astype(np.int64)
    s_start[1:] = np.cumsum(s_cnt)[:-1]
    bS = spark.sparkContext.broadcast((S, s_start, s_cnt))

    def assign_sub(batches):
        Sv, st, cn = bS.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = _mat(pdf["_v"])
            cell = pdf["cell"].to_numpy(dtype=np.int64)
            g = np.zeros(len(X), dtype=np.int64)
            ds = np.zeros(len(X))
            for c in np.unique(cell):
                rows = np.nonzero(cell == c)[0]
                D = _dist_chunked(X[rows], Sv[st[c]:st[c] + cn[c]])
                a = D.argmin(axis=1)
                g[rows] = st[c] + a
                ds[rows] = D[np.arange(len(rows)), a]
            yield pd.DataFrame({"_id": pdf["_id"].astype("int64"), "_v": pdf["_v"], "g": g, "ds": ds})

    subs = cells.mapInPandas(assign_sub, "_id long, _v array<double>, g long, ds double")
    sub_n = F.broadcast(subs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("np")))
    blocked = (subs.join(sub_n, "g")
               .withColumn("blk", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.col("np")).cast("int"))
               .drop("np").transform(materialize))
    bstat = sorted((r["g"], r["blk"], r["r"], r["n"]) for r in
                   blocked.groupBy("g", "blk").agg(F.max("ds").alias("r"), F.count(F.lit(1)).alias("n")).collect())
    Ns = len(S)
    B_g = np.array([b[0] for b in bstat], dtype=np.int64)
    B_blk = np.array([b[1] for b in bstat], dtype=np.int64)
    B_r = np.array([b[2] for b in bstat], dtype=float)
    B_n = np.array([b[3] for b in bstat], dtype=np.int64)
    b_start = np.zeros(Ns, dtype=np.int64)
    b_cnt = np.bincount(B_g, minlength=Ns).astype(np.int64)
    b_start[1:] = np.cumsum(b_cnt)[:-1]
    R_sub = np.zeros(Ns)
    n_sub = np.zeros(Ns, dtype=np.int64)
    np.maximum.at(R_sub, B_g, B_r)
    np.add.at(n_sub, B_g, B_n)
    U = np.zeros(len(P))
    n_cell = np.zeros(len(P), dtype=np.int64)
    np.maximum.at(U, S_cell, R_sub + _rowdist(S, np.arange(Ns), P, S_cell))  # ball about p_c
    np.add.at(n_cell, S_cell, n_sub)
    bB = spark.sparkContext.broadcast((B_g, B_blk, B_r, b_start, b_cnt, R_sub, n_sub, S_cell, U, n_cell, PP))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["_id"].to_numpy(dtype=np.int64)
        X = _mat(pdf["_v"])
        return _knn_block(ids, X, ids, X, k)

    p1 = blocked.groupBy("g", "blk").applyInPandas(local, _SCHEMA).transform(materialize)
    theta = (p1.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("d")))
             .where(F.col("_r") == k).select("i", F.col("d").alias("theta")))
    q = (blocked.join(theta, blocked["_id"] == theta["i"], "left")
         .select("_id", "_v", "g", "blk", F.coalesce(F.col("theta"), F.lit(float("inf"))).alias("theta")))

    @F.pandas_udf("theta double, blocks array<long>")
    def route(v: pd.Series, g: pd.Series, blk: pd.Series, theta: pd.Series) -> pd.DataFrame:
        Bg, Bb, Br, bst, bcn, Rs, ns, Sc, Uc, nc, PPm = bB.value
        Sv, sst, scn = bS.value
        Pv = bP.value
        big_c = np.nonzero(nc > k)[0]
        # points per slice: at most ~4M (point, sub-cell) pairs in flight
        step = max(1, min(256, (4 << 20) // max(1, len(Sv))))
        thetas, blocks = theta.to_numpy(dtype=float).copy(), []
        for lo in range(0, len(v), step):
            X = _mat(v.iloc[lo:lo + step])
            Dp = _dist_chunked(X, Pv)
            own_g = g.iloc[lo:lo + step].to_numpy(dtype=np.int64)
            own_b = blk.iloc[lo:lo + step].to_numpy(dtype=np.int64)
            own_c = Sc[own_g]
            th = thetas[lo:lo + step]
            if len(big_c):
                np.minimum(th, (Dp[:, big_c] + Uc[big_c][None, :]).min(axis=1), out=th)
            tol = th + EPS * (1 + th)
            own = Dp[np.arange(len(Dp)), own_c][:, None]
            sep = PPm[own_c]
            with np.errstate(divide="ignore", invalid="ignore"):
                hyper = np.where(sep > 0, (Dp * Dp - own * own) / (2 * sep), 0.0)
            lb_cell = np.maximum(np.maximum(Dp - Uc[None, :], 0.0), hyper)
            r, c = np.nonzero(lb_cell <= tol[:, None])  # surviving (point, cell) pairs
            # expand to the sub-cells of each surviving cell
            k_s = scn[c]
            rr = np.repeat(r, k_s)
            gi = np.repeat(sst[c] - (np.cumsum(k_s) - k_s), k_s) + np.arange(k_s.sum())
            dq = _rowdist(X, rr, Sv, gi)
            lb = np.maximum(lb_cell[rr, Sc[gi]], dq - Rs[gi])
            same = Sc[gi] == own_c[rr]
            if same.any():
                og = own_g[rr[same]]
                dso = _rowdist(X, rr[same], Sv, og)
                sep2 = _rowdist(Sv, og, Sv, gi[same])
                with np.errstate(divide="ignore", invalid="ignore"):
                    h2 = np.where(sep2 > 0, (dq[same] ** 2 - dso ** 2) / (2 * sep2), 0.0)
                lb[same] = np.maximum(lb[same], h2)
            ok = lb <= tol[rr]
            rr, gi, dq, lb = rr[ok], gi[ok], dq[ok], lb[ok]
            # expand to the blocks of each surviving sub-cell
            k_b = bcn[gi]
            r2 = np.repeat(rr, k_b)
            bi = np.repeat(bst[gi] - (np.cumsum(k_b) - k_b), k_b) + np.arange(k_b.sum())
            lb2 = np.maximum(np.repeat(lb, k_b), np.repeat(dq, k_b) - Br[bi])
            keep = (lb2 <= tol[r2]) & ~((Bg[bi] == own_g[r2]) & (Bb[bi] == own_b[r2]))
            r2, bi = r2[keep], bi[keep]  # r2 ascends
            blocks += np.split((Bg[bi] << 32) + Bb[bi], np.searchsorted(r2, np.arange(1, len(X))))
        return pd.DataFrame({"theta": thetas, "blocks": blocks})

    # one row per point, with the blocks it goes to: the copies are made on the way to the next shuffle
    routed = (q.select("_id", "_v", route("_v", "g", "blk", "theta").alias("_r")).select("_id", "_v", "_r.theta", "_r.blocks")
              .where(F.size("blocks") > 0).transform(materialize))
    routed = routed.select("_id", "_v", "theta", F.explode("blocks").alias("b"))
    # queries per target block -> number of query chunks; one row per block (bounded table),
    # joined by broadcast instead of being shipped as a literal
    chunks = F.broadcast(routed.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nq")))
    qside = (routed.join(chunks, "b")
             .select("b", F.pmod(F.xxhash64("_id", F.lit(seed + 2)), F.col("nq")).cast("int").alias("qc"), "theta", "_id", "_v"))
    dside = (blocked.withColumn("b", F.shiftleft("g", 32) + F.col("blk")).join(chunks, "b")
             .select("b", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qc"),
                     F.lit(None).cast("double").alias("theta"), "_id", "_v"))  # no query: no limit

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["theta"].notna()
        qs, xs = pdf[is_q], pdf[~is_q]
        return _knn_block(qs["_id"].to_numpy(dtype=np.int64), _mat(qs["_v"]), xs["_id"].to_numpy(dtype=np.int64),
                          _mat(xs["_v"]), k, qs["theta"].to_numpy(dtype=float))

    p2 = qside.unionByName(dside).groupBy("b", "qc").applyInPandas(cross, _SCHEMA)
    allc = p1.unionByName(p2)
    # all candidates within the k-th distance (rank keeps every tie at the k-th value)
    return (allc.withColumn("_rk", F.rank().over(Window.partitionBy("i").orderBy("d")))
            .where(F.col("_rk") <= k).drop("_rk"))


def _smallest_ids(members: DataFrame, r: int, block: int, max_m: int, seed: int) -> DataFrame:
    """``(_v, _id)``: the ``r`` smallest ids of every copy group, by a salted tree reduction.

    Stage 0 splits each group over ``S`` salts (about ``block`` rows per window partition); each
    later stage merges ``fan`` salts, whose survivors are at most ``fan * r`` rows. No window
    partition ever holds more than about ``block`` rows, however large a group is.
    """
    fan = max(2, block // r)
    S = max(1, math.ceil(max_m / block))
    cur = members.select("_v", "_id", F.pmod(F.xxhash64("_id", F.lit(seed + 3)), F.lit(S)).alias("s"))
    while True:
        w = Window.partitionBy("_v", "s").orderBy("_id")
        cur = cur.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= r).drop("_rn")
        if S == 1:
            return cur.drop("s")
        S = max(1, math.ceil(S / fan))
        cur = cur.withColumn("s", F.col("s") % F.lit(S))


def knn_join(df: DataFrame, id_col: str, vec_col: str, k: int = 10, block: int | None = None,
             max_pivots: int = 2048, seed: int = 17) -> DataFrame:
    """``(i, j, d, rank)``: the k nearest other points of every point; ties broken by id."""
    spark = df.sparkSession
    pts = (df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
           .transform(materialize))
    groups = (pts.groupBy("_v").agg(F.count(F.lit(1)).alias("m"), F.min("_id").alias("g"))
              .transform(materialize))
    max_m = groups.agg(F.max("m")).first()[0]
    if max_m is None:
        return spark.createDataFrame([], "i long, j long, d double, rank int")
    dk = _distinct_knn(groups.select(F.col("g").alias("_id"), "_v"), k, block, max_pivots, seed)
    by_dj = Window.partitionBy("i").orderBy("d", "j")
    if max_m == 1:  # no copies: distinct vectors are the points
        return (dk.withColumn("rank", F.row_number().over(by_dj)).where(F.col("rank") <= k)
                .select("i", "j", "d", F.col("rank").cast("int")))
    dk = dk.transform(materialize)
    small = _smallest_ids(pts, k + 1, block or BLOCK, max_m, seed)
    small_g = small.join(groups.select("_v", "g"), "_v").select("g", "_id")  # <= k+1 rows per group
    own = small_g.select(F.col("g").alias("u"), F.col("_id").alias("j"), F.lit(0.0).alias("d"))
    nbr = (dk.join(small_g.withColumnRenamed("g", "j_g"), dk["j"] == F.col("j_g"))
           .select(F.col("i").alias("u"), F.col("_id").alias("j"), "d"))
    by_u = Window.partitionBy("u").orderBy("d", "j")
    lists = (own.unionByName(nbr).withColumn("_rn", F.row_number().over(by_u)).where(F.col("_rn") <= k + 1)
             .join(groups.select(F.col("g").alias("u"), "_v"), "u").select("_v", "j", "d"))
    # a hot copy group's members meet its k+1-row list: salted, so no task holds the whole group
    out = (salted_join(pts, lists, "_v", ["_id"]).where(F.col("j") != F.col("_id"))
           .select(F.col("_id").alias("i"), "j", "d"))
    return (out.withColumn("rank", F.row_number().over(by_dj)).where(F.col("rank") <= k)
            .select("i", "j", "d", F.col("rank").cast("int")))


def local_outlier_factor(knn: DataFrame) -> DataFrame:
    """``(i, lof)`` from a k-nearest-neighbour table ``(i, j, d)``: three equi-joins, no pairs.

    A point whose reach distances are all zero (exact copies) has infinite density; its factor
    is defined as 1. A point of finite density with such a neighbour has an infinite factor.
    """
    knn = knn.select("i", "j", "d").transform(materialize)  # read three times below
    kd = knn.groupBy("i").agg(F.max("d").alias("kd"))
    # the smallest ids of a hot copy group are everybody's neighbours: salted joins on j
    reach = salted_join(knn, kd.withColumnRenamed("i", "j").withColumnRenamed("kd", "kd_j"), "j", ["i"])
    lrd = (reach.groupBy("i").agg((1.0 / F.nullif(F.avg(F.greatest("d", "kd_j")), F.lit(0.0))).alias("lrd"))
           .transform(materialize))
    lj = salted_join(knn, lrd.withColumnRenamed("i", "j").withColumnRenamed("lrd", "lrd_j"), "j", ["i"])
    agg = lj.groupBy("i").agg(F.avg("lrd_j").alias("avg_lrd_j"), F.count("lrd_j").alias("n_fin"),
                              F.count(F.lit(1)).alias("n_all"))
    out = agg.join(lrd, "i")
    return out.select("i", F.when(F.col("lrd").isNull(), F.lit(1.0))
                      .when(F.col("n_fin") < F.col("n_all"), F.lit(float("inf")))
                      .otherwise(F.col("avg_lrd_j") / F.col("lrd")).alias("lof"))


def top_outliers(df: DataFrame, id_col: str, vec_col: str, k: int = 10, n: int = 5, **kw) -> DataFrame:
    """The ``n`` rows with the highest local outlier factor, infinite ones first (a top-n report)."""
    lof = local_outlier_factor(knn_join(df, id_col, vec_col, k, **kw))
    return (lof.orderBy(F.col("lof").desc(), F.col("i"))
            .limit(n).select(F.col("i").alias(id_col), "lof"))
