"""Exact threshold pairs of embeddings by cover trees and dual traversal.

Vectors are compared by cosine within a group (equal labels and dimensions), that is by the distance of
their unit vectors. Equal vectors form one point with a number of copies.

* **Upper levels, in Spark.** The root of a group splits into cells around centres drawn from its points,
  about one per ``BLOCK`` points and ``MAX_CENTRES`` in all, so what is broadcast and traversed on the driver
  is bounded. Cells go on as blocks of about ``BLOCK`` points, whatever their number. Pairs of cells whose
  centres are further apart than both covering radii and the threshold allow are pruned; every other
  pair of blocks is a task of bounded size.
* **Lower levels, in numpy.** A block becomes a cover tree of nested levels: a centre stays a centre below,
  covering radii halve from level to level, and each node keeps the largest distance to a point under
  it. Two trees are traversed together: a pair of nodes is dropped if its centres are further apart than
  both covering radii and the threshold allow, else its children are paired; points meet at the bottom
  and are compared by their cosine.

A task returns one row per linked point: the copies it is linked to, and the smallest point it is connected
with; pairs are listed only by :func:`threshold_pairs`.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.components import components
from auger.llm.jaccard import _stars
from auger.session import write_scratch

BLOCK, MAX_CENTRES = 2048, 4096
SLACK = 1e-7  # of distances: roots of differences near zero keep half the digits of a double


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Levels of nodes over the unit vectors ``points``; ``order`` lists the points so that each node is a
    slice. A level holds for each node ``begin, end`` (slice), ``centre`` (row of ``points``), ``radius`` (the
    largest distance from the centre to its points) and ``child`` (offsets into the next level)."""

    def __init__(self, points: np.ndarray, finest: float):
        self.points = points
        n = len(points)
        rows = np.arange(n)
        reach = _distance(points[:1], points)[0]
        nodes = [(rows, 0, float(reach.max()))]
        self.levels = []
        bound = nodes[0][2] / 2
        while True:
            sizes = np.array([len(r) for r, _, _ in nodes])
            level = {"begin": np.concatenate(([0], np.cumsum(sizes)[:-1])), "end": np.cumsum(sizes),
                     "centre": np.array([c for _, c, _ in nodes]), "radius": np.array([r for _, _, r in nodes])}
            self.levels.append(level)
            self.order = np.concatenate([r for r, _, _ in nodes])
            if level["radius"].max() <= finest:
                break
            below, child = [], [0]
            for r, c, radius in nodes:
                below += self._split(r, c, bound) if radius > finest else [(r, c, radius)]
                child.append(len(below))
            level["child"] = np.array(child)
            nodes, bound = below, bound / 2

    def _split(self, rows: np.ndarray, centre: int, bound: float) -> list[tuple[np.ndarray, int, float]]:
        out, x = [], self.points[rows]
        left = np.arange(len(rows))
        while len(left):
            d = _distance(self.points[centre][None], x[left])[0]
            near = d <= bound
            near |= rows[left] == centre
            out.append((rows[left[near]], centre, float(d[near].max())))
            left = left[~near]
            if len(left):
                centre = int(rows[left[0]])
        return out


def dual_traversal(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of a, row of b) of cosine ``threshold`` or more; with ``a is b`` both ways round."""
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    far = lambda la, ia, lb, ib: (_distance(a.points[la["centre"][ia]], b.points[lb["centre"][ib]])
                                  > la["radius"][ia][:, None] + lb["radius"][ib][None, :] + reach)
    pairs = [(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]  # groups of nodes all paired with each other
    depth = max(len(a.levels), len(b.levels))
    for i in range(depth):
        la, lb = a.levels[min(i, len(a.levels) - 1)], b.levels[min(i, len(b.levels) - 1)]
        kept = []
        for ia, ib in pairs:
            for at in range(0, len(ia), 512):
                x, y = np.nonzero(~far(la, ia[at:at + 512], lb, ib))
                kept += zip(ia[at + x], ib[y])
        if i == depth - 1:
            break
        down = lambda tree, level, k: (np.arange(level["child"][k], level["child"][k + 1])
                                       if i < len(tree.levels) - 1 else np.array([k]))
        pairs = [(down(a, la, x), down(b, lb, y)) for x, y in kept]
    left, right = [], []
    for x, y in kept:
        ra, rb = a.order[la["begin"][x]:la["end"][x]], b.order[lb["begin"][y]:lb["end"][y]]
        u, v = np.nonzero(a.points[ra] @ b.points[rb].T >= threshold)
        left.append(ra[u])
        right.append(rb[v])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assign(centres, out_names):
    """Cell of each point: the nearest centre of its group, and the distance to it."""

    def run(batches):
        for b in batches:
            group = b.column("grp").to_numpy()
            cell, radius = np.zeros(len(group), dtype=np.int64), np.zeros(len(group))
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                ids, points = centres.value[g]
                x = _unit(_matrix(b.column("vec").take(pa.array(at))))
                for lo in range(0, len(at), 4096):
                    d = _distance(x[lo:lo + 4096], points)
                    best = d.argmin(axis=1)
                    cell[at[lo:lo + 4096]] = ids[best]
                    radius[at[lo:lo + 4096]] = d[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in out_names] + [pa.array(cell), pa.array(radius)],
                                             names=[*out_names, "cell", "radius"])

    return run


def _pack(threshold: float):
    finest = (2 - 2 * threshold) ** 0.5 / 4

    def run(batches):
        for b in batches:
            for i, members in enumerate(b.column("members")):
                flat = members.values
                rep, copies = (flat.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(rep)
                x = _unit(_matrix(flat.field(2)))[order]
                tree = pickle.dumps((rep[order], copies[order], CoverTree(x, finest)), protocol=5)
                yield pa.RecordBatch.from_arrays([b.column("cell").slice(i, 1), b.column("block").slice(i, 1), pa.array([tree], pa.binary())],
                                                 names=["cell", "block", "tree"])

    return run


def _meet(threshold: float, listed: bool):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                same = batch.column("same")[i].as_py()
                rep, copies, a = pickle.loads(batch.column("tree_a")[i].as_buffer())
                rep_b, copies_b, b = (rep, copies, a) if same else pickle.loads(batch.column("tree_b")[i].as_buffer())
                x, y = dual_traversal(a, b, threshold)
                if same:
                    x, y = x[x != y], y[x != y]
                if listed:
                    p, q = np.minimum(rep[x], rep_b[y]), np.maximum(rep[x], rep_b[y])
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])
                    continue
                if not len(x):
                    continue
                if same:
                    ids, links = rep, np.bincount(x, weights=copies[y], minlength=len(rep))
                    u, v = x, y
                else:
                    ids = np.concatenate([rep, rep_b])
                    links = np.concatenate([np.bincount(x, weights=copies_b[y], minlength=len(rep)),
                                            np.bincount(y, weights=copies[x], minlength=len(rep_b))])
                    u, v = np.concatenate([x, y + len(rep)]), np.concatenate([y + len(rep), x])
                some, small = np.unique(u, return_inverse=True)
                some = some[np.argsort(ids[some], kind="stable")]
                place = np.empty(len(ids), dtype=np.int64)
                place[some] = np.arange(len(some))
                linked = np.zeros((len(some), len(some)), dtype=bool)
                linked[place[u], place[v]] = True
                root = _stars(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(np.rint(links[some]).astype(np.int64)), pa.array(ids[some][root])],
                    names=["point", "links", "head"])

    return run


def _points(vectors: DataFrame, vec_id: str, vec: str, group: str) -> DataFrame:
    usable = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists(vec, lambda x: x != 0) & F.col(group).isNotNull(), F.lit(False))
    return vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"), F.col(group).alias("label"),
        F.monotonically_increasing_id().alias("row"), usable.alias("usable"),
        F.xxhash64(vec).alias("s1"), F.xxhash64(vec, F.lit(1)).alias("s2"))


def _block_pairs(points: DataFrame, threshold: float) -> DataFrame:
    """The pairs of packed blocks that the covering radii do not prune. ``points``: point, copies, label, vec."""
    spark = points.sparkSession
    points = points.withColumn("dim", F.size("vec"))
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    groups = write_scratch(sizes.withColumn("grp", F.monotonically_increasing_id()), "groups")
    points = write_scratch(points.join(groups, ["label", "dim"])
                           .select("point", "copies", "grp", "vec", "n"), "points")
    total = max(1, points.count())
    per = max(BLOCK, -(-total // MAX_CENTRES * 2))  # about total / per centres
    # groups of up to `per` points are one cell; each of the others, at most total / per, has its first point too
    drawn = points.where(F.pmod(F.xxhash64("point", F.lit("centre")), F.lit(per)) == 0).where(F.col("n") > per)
    first = points.groupBy("grp").agg(F.min("point").alias("point"))
    small = groups.where(F.col("n") <= per).select("grp")
    many = points.join(small, "grp", "left_anti")
    centre_rows = (drawn.select("grp", "point", "vec")
                   .unionByName(many.join(first, ["grp", "point"], "left_semi").select("grp", "point", "vec")).distinct().collect())
    centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    by_group: dict[int, list] = {}
    for r in centre_rows:
        by_group.setdefault(r["grp"], []).append(r)
    for g, rows in by_group.items():
        centres[g] = (np.array([r["point"] for r in rows]), _unit(np.array([r["vec"] for r in rows], dtype=np.float64)))
    shared = spark.sparkContext.broadcast(centres)
    names = ["point", "copies", "grp", "vec"]
    large = many.select(*names).mapInArrow(_assign(shared, names), many.select(*names).schema.add("cell", "long").add("radius", "double"))
    whole = points.join(small, "grp", "left_semi").select(*names, (-F.col("grp") - 1).alias("cell"), F.lit(2.0).alias("radius"))
    placed = write_scratch(large.unionByName(whole), "cells")
    cells = placed.groupBy("grp", "cell").agg(F.max("radius").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    cells = write_scratch(cells, "cell-sizes")
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    near = []
    for g, found in _grouped(cells.where("cell >= 0").collect()):  # at most one row per centre
        ids, points_of = centres[g]
        at = {c: i for i, c in enumerate(ids)}
        radius = np.array([r["radius"] for r in found])
        mine = points_of[[at[r["cell"]] for r in found]]
        for i in range(len(found)):
            d = _distance(mine[i:i + 1], mine[i:])[0]
            near += [(int(found[i]["cell"]), int(found[i + k]["cell"])) for k in np.flatnonzero(d <= radius[i] + radius[i:] + reach)]
    pairs = spark.createDataFrame(near, "a long, b long").unionAll(cells.where("cell < 0").select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    count = cells.select("cell", "n_blocks")
    pairs = (pairs.join(count.toDF("a", "na"), "a").join(count.toDF("b", "nb"), "b")
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .where("a != b or i <= j").select("a", "i", "b", "j"))
    blocks = (placed.join(count, "cell").withColumn("block", F.pmod(F.xxhash64("point"), F.col("n_blocks")).cast("int"))
              .groupBy("cell", "block").agg(F.collect_list(F.struct("point", "copies", "vec")).alias("members")))  # about BLOCK
    blocks = write_scratch(blocks.mapInArrow(_pack(threshold), "cell long, block int, tree binary"), "blocks")
    same = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    return (pairs.join(blocks.toDF("a", "i", "tree_a"), ["a", "i"]).join(blocks.toDF("b", "j", "tree_b"), ["b", "j"])
            .select("tree_a", F.when(~same, F.col("tree_b")).alias("tree_b"), same.alias("same")))


def _grouped(rows):
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["grp"], []).append(r)
    return out.items()


def _classes(base: DataFrame) -> DataFrame:
    keys = ["label", "s1", "s2"]
    return write_scratch(base.where("usable").groupBy(*keys).agg(F.min("row").alias("point"), F.count(F.lit(1)).alias("copies")), "points-distinct")


def _distinct_points(base: DataFrame, classes: DataFrame) -> DataFrame:
    return base.select(F.col("row").alias("point"), "label", "vec").join(classes.select("point", "copies"), "point")


def threshold_pairs(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", vec: str = "embedding", group: str = "label") -> DataFrame:
    """``a, b`` (a < b): all pairs of different vectors of one group with a cosine of at least ``threshold``;
    of equal vectors only the first row stands for all."""
    base = write_scratch(_points(vectors, vec_id, vec, group), "vectors")
    found = _block_pairs(_distinct_points(base, _classes(base)), threshold).mapInArrow(_meet(threshold, True), "a long, b long").distinct()
    ids = base.select("row", "vec_id")
    pair = found.join(ids.toDF("a", "ida"), "a").join(ids.toDF("b", "idb"), "b")
    return pair.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", vec: str = "embedding", group: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Rows are linked if their groups are equal and not null and their cosine is at least ``threshold``; a
    vector that is null, empty, all zero, or holds a null or non-finite component, and one of another
    dimension, links with nothing. ``component_id``: smallest id reachable by links; ``kept``: the row has
    it. Repeated ids stay separate rows; a null id is not smaller than another. Other columns are
    ignored; an empty table gives an empty result."""
    base = write_scratch(_points(vectors, vec_id, vec, group), "vectors")
    classes = _classes(base)
    checked = write_scratch(_block_pairs(_distinct_points(base, classes), threshold)
                            .mapInArrow(_meet(threshold, False), "point long, links long, head long"), "links")
    links = checked.groupBy("point").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("head").alias("a"), F.col("point").alias("b")))
    heads = (classes.join(links, "point", "left").join(joined.withColumnRenamed("id", "point"), "point", "left")
             .select("label", "s1", "s2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "point").alias("class")))
    rows = base.select("row", "vec_id", "usable", F.when(F.col("usable"), F.col("label")).alias("label"), "s1", "s2")
    placed = write_scratch(rows.join(heads, ["label", "s1", "s2"], "left")
                           .select("row", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "row").alias("class")), "placed")
    # written, so that both sides of the join are plain shuffles, which Spark splits where a class is large
    least = write_scratch(placed.groupBy("class").agg(F.min("vec_id").alias("component_id")), "least")
    return placed.join(least, "class").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
