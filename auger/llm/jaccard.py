"""N-gram Jaccard join of texts by chosen paths.

Texts are compared by the sets of their five-word shingles. Texts with equal sets form one class, which
goes on as one set with a number of copies. Every set is embedded as ``SKETCH`` min-hash tokens (place,
value), so a shared token has the set similarity as its probability.

* **Chosen paths.** In each of ``RUNS`` runs all sets start in one bucket. A bucket is split on places
  sampled by a hash of its path, one and with probability 1/threshold - 1 a second, so a token is taken
  with probability 1 / (threshold x tokens): a set goes to one sub-bucket for each sampled place, named
  by the path, the place and the token. Buckets of one set end, buckets up to ``LEAF`` are compared by
  brute force on the sketches, larger ones are split again.
  A pair of similarity 0.8 stays together through four levels of a run with probability 0.576, so eight
  runs find it with probability 0.999, and more for more similar pairs or buckets that end earlier.
* **Buckets still large after** ``DEPTH`` **splits** are not cut short: all their sets become candidates of
  each other (linked in a star), which the exact step sorts out.
* **Exact step.** Candidates are gathered into groups (connected candidates), each set once; a group above
  ``BLOCK`` sets or ``BLOCK_TOKENS`` tokens is dealt into blocks, and every pair of blocks is a task of bounded
  size. All pairs of a group are compared on their whole sets. Each task returns one row per set: the
  copies it is linked to, and the smallest set it is connected with; pairs are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.llm.components import components
from auger.llm.words import Words, mix, repeats_by_text, shingles, text_batches
from auger.session import drop_scratch, write_scratch

SHINGLE, THRESHOLD = 5, 0.8
SKETCH, RUNS, DEPTH, LEAF = 64, 8, 4, 64
CANDIDATE = 0.5  # share of equal sketch tokens; 0.8 lies six standard deviations above
BLOCK, BLOCK_TOKENS = 512, 1_000_000
TEXT_BYTES = 500_000  # bytes of text a worker shingles at once

_PLACES = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x51ED270B)) | np.uint64(1)
_I64 = lambda x: np.ascontiguousarray(x).view(np.int64)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    return repeats_by_text(*shingles(words.hash, words.off, k))


def signatures(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on each set alone."""
    out = []
    for v in (mix(values), mix(values ^ _PLACES[0])):
        run = np.zeros(len(v) + 1, dtype=np.uint64)
        np.cumsum(v, out=run[1:])
        out.append(_I64(run[off[1:]] - run[off[:-1]]))
    return out[0], out[1]


def _sketches(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, SKETCH) min-hash values; rows of empty sets are zero."""
    n = len(off) - 1
    out = np.zeros((n, SKETCH), dtype=np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        for j, a in enumerate(_PLACES):
            out[full, j] = np.minimum.reduceat(((values * a) >> np.uint64(32)).astype(np.uint32), off[full])
    return out


def _read(rows: pa.RecordBatch, name: str) -> np.ndarray:
    flat = rows.column(name)
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint32).reshape(len(flat), SKETCH)


def _sampled(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place each path is split on, and a second one or -1."""
    r = mix(paths)
    first = (r % np.uint64(SKETCH)).astype(np.int64)
    other = (first + 1 + ((r >> np.uint64(16)) % np.uint64(SKETCH - 1)).astype(np.int64)) % SKETCH
    second = ((r >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.float64) / 65536 < 1 / THRESHOLD - 1
    return first, np.where(second, other, -1)


def _children(paths: np.ndarray, rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out_path, out_row = [], []
    for place in _sampled(paths):
        at = np.flatnonzero(place >= 0)
        token = sketch[at, place[at]].astype(np.uint64) + (place[at].astype(np.uint64) << np.uint64(32))
        out_path.append(mix(mix(paths[at]) + token))
        out_row.append(rows[at])
    return np.concatenate(out_path), np.concatenate(out_row)


def _path_batch(paths: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_I64(paths)), pa.array(rows)], names=["path", "row"])


def _first_level(batches):
    roots = mix(np.arange(1, RUNS + 1, dtype=np.uint64) << np.uint64(32))
    for b in batches:
        rows, sketch = b.column("row").to_numpy(), _read(b, "sketch")
        for root in roots:
            yield _path_batch(*_children(np.full(len(rows), root), rows, sketch))


def _next_level(batches):
    for b in batches:
        yield _path_batch(*_children(b.column("path").to_numpy().view(np.uint64), b.column("row").to_numpy(), _read(b, "sketch")))


def _stars(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row it is connected with."""
    root = np.arange(len(linked))
    while True:
        best = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _leaf_edges(batches):
    for b in batches:
        a_out, b_out = [], []
        for group in b.column("sets").to_pylist():
            rows = np.array([g["row"] for g in group])
            order = np.argsort(rows)
            rows = rows[order]
            sketch = np.frombuffer(b"".join(g["sketch"] for g in group), dtype=np.uint32).reshape(-1, SKETCH)[order]
            same = (sketch[:, None, :] == sketch[None, :, :]).sum(axis=2) >= CANDIDATE * SKETCH
            root = _stars(same)
            a_out.append(rows[root])
            b_out.append(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a_out, b_out)], names=["a", "b"])


def candidates(sets: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``a, b``: stars that connect all sets which some run brought together. ``sets``: row, sketch.
    The tables that the result reads are added to ``scratch``."""
    edges, scratch = None, [] if scratch is None else scratch
    paths = write_scratch(sets.mapInArrow(_first_level, "path long, row long"), "paths")
    for depth in range(1, DEPTH + 1):
        # written, so that both sides of the join are plain shuffles, which Spark splits where a bucket is large
        size = write_scratch(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("head")).where("n > 1"), "sizes")
        shared = write_scratch(paths.join(size, "path"), "shared-paths")
        scratch.append(shared)
        drop_scratch(paths)
        drop_scratch(size)
        small = shared.where(F.col("n") <= LEAF).join(sets, "row")
        small = small.groupBy("path").agg(F.collect_list(F.struct("row", "sketch")).alias("sets"))  # LEAF sets at most
        found = small.select("sets").mapInArrow(_leaf_edges, "a long, b long").where("a < b")
        large = shared.where(F.col("n") > LEAF)
        if depth == DEPTH:
            found = found.unionAll(large.select(F.col("head").alias("a"), F.col("row").alias("b")))
        edges = found if edges is None else edges.unionAll(found)
        if depth < DEPTH:
            paths = write_scratch(large.select("path", "row").join(sets, "row").select("path", "row", "sketch")
                                  .mapInArrow(_next_level, "path long, row long"), "paths")
            if paths.isEmpty():
                break
    scratch.append(paths)
    return edges


def _linked(sets: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    """Symmetric matrix: similarity of at least ``threshold``; with ``split`` only pairs across it."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    token, owner = number[token[keep]], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width, n_tokens = 4096, int(shared.sum())
    for at in range(0, n_tokens, width):
        lo, hi = np.searchsorted(token, [at, at + width])
        who, column = np.unique(owner[lo:hi], return_inverse=True)
        part = np.zeros((len(who), min(width, n_tokens - at)), dtype=np.float32)
        part[column, token[lo:hi] - at] = 1
        common[np.ix_(who, who)] += part @ part.T
    common = common.astype(np.float64)
    linked = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    if split is not None:
        side = np.arange(len(sets)) < split
        linked &= side[:, None] != side[None, :]
    return linked


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            for group, cross in zip(b.column("sets"), b.column("is_cross").to_pylist()):
                members = sorted(group.as_py(), key=lambda g: (g["second"], g["row"]))
                rows = np.array([g["row"] for g in members])
                sets = [np.frombuffer(g["tokens"], dtype=np.uint64) for g in members]
                split = sum(not g["second"] for g in members) if cross else None
                linked = _linked(sets, split, threshold)
                copies = np.array([g["copies"] for g in members])
                links = linked @ copies
                order = np.argsort(rows, kind="stable")
                root = _stars(linked[np.ix_(order, order)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[order]), pa.array(links[order].astype(np.int64)), pa.array(rows[order][root])],
                    names=["row", "links", "head"])

    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            for b in text_batches(batch, TEXT_BYTES):
                values, off = shingle_sets(b.column("text").to_pylist(), k)
                s1, s2 = signatures(values, off)
                same = (s1 == b.column("s1").to_numpy()) & (s2 == b.column("s2").to_numpy())
                at = np.flatnonzero(same)
                tokens = [values[off[i]:off[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(at)) for c in ("row", "copies", "grp", "n_blocks")] + [pa.array(tokens, pa.binary())],
                    names=["row", "copies", "grp", "n_blocks", "tokens"])

    return run


def _sketch_rows(k: int):
    def run(batches):
        for batch in batches:
            for b in text_batches(batch, TEXT_BYTES):
                values, off = shingle_sets(b.column("text").to_pylist(), k)
                s1, s2 = signatures(values, off)
                sketch = _sketches(values, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), b.column("text_key"), pa.array(s1), pa.array(s2),
                     pa.array(np.diff(off).astype(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["row", "doc_id", "text_key", "s1", "s2", "n", "sketch"])

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, row: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, text_key, class_id, n_links, kept``; with ``row``,
    a column of ``docs`` with a number for each row, written with it, that number as ``row`` too.

    ``n_links``: other rows whose shingle set has a Jaccard similarity of at least ``threshold`` (equal
    texts count); ``class_id``: smallest doc_id reachable by links; ``kept``: the one row of the class
    that has that id (of repeated rows the first). ``text_key`` hashes the text, to join back. Texts
    without a word (null, empty, punctuation) link with nothing. A null id is not smaller than any
    other. Other columns are ignored. ``threshold`` must be at least ``THRESHOLD`` for the recall above."""
    base = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"),
                       (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"))
    base = write_scratch(base.mapInArrow(
        _sketch_rows(k), "row long, doc_id long, text_key long, s1 long, s2 long, n long, sketch binary"), "sketches")
    some = base.where("n > 0")
    classes = write_scratch(some.groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    sets = base.select("row", "sketch").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    used = [write_scratch(sets, "sets")]
    grouped = write_scratch(components(candidates(used[0], used)), "candidate-groups")
    for t in used:
        drop_scratch(t)
    of_class = classes.select(F.col("rep").alias("row"), "s1", "s2", "n", "copies")
    members = of_class.join(grouped.select(F.col("id").alias("row"), F.col("component").alias("grp")), "row")
    blocks = members.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("n_blocks"))
    blocks = write_scratch(blocks, "blocks")
    wanted = members.join(blocks, "grp").join(base.select("row", "doc_id", "text_key"), "row")
    if row:
        texts = docs.select(F.col(f"`{row}`").alias("__row"), "text")
        of_set = texts["__row"] == wanted["row"]
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
        of_set = texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["key"] == wanted["text_key"])
    tokens = (texts.join(wanted, of_set)
              .select("row", "copies", "grp", "n_blocks", "s1", "s2", "text")
              .mapInArrow(_set_rows(k), "row long, copies long, grp long, n_blocks int, tokens binary"))
    own = F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = tokens.withColumn("own", own).withColumn("other", other).select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.struct("row", "copies", (F.col("own") > F.col("other")).alias("second"), "tokens").alias("set"))
    tasks = dealt.groupBy("grp", "i", "j").agg(F.collect_set("set").alias("sets"))  # two blocks at most
    checked = write_scratch(tasks.select("sets", (F.col("i") < F.col("j")).alias("is_cross"))
                            .mapInArrow(_verify(threshold), "row long, links long, head long"), "checked")
    links = checked.groupBy("row").agg(F.sum("links").alias("links"))
    joined = components(checked.where("row != head").select(F.col("head").alias("a"), F.col("row").alias("b")))
    heads = classes.join(links.withColumnRenamed("row", "rep"), "rep", "left").join(
        joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    heads = heads.select("s1", "s2", "n", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "rep").alias("class"))
    placed = write_scratch(
        base.select("row", "doc_id", "text_key", "s1", "s2", "n").join(heads, ["s1", "s2", "n"], "left")
        .select("row", "doc_id", "text_key", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("class", F.col("row")).alias("class")), "placed")
    for t in (base, classes, grouped, blocks, checked):
        drop_scratch(t)
    # written, so that both sides of the join below are plain shuffles, which Spark splits where a class is large
    first = write_scratch(placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("m")), "first")
    return (placed.join(first, "class")
            .select("doc_id", "text_key", F.col("m.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("m.row")).alias("kept"),
                    *(["row"] if row else [])))
