"""Near-duplicate passages across documents by compact windows.

A text is its sequence of five-word shingles. Under a hash function, all parts of a text whose smallest
shingle hash stands at place c form a compact window (l, c, r): the span of c in the Cartesian tree of
the hashes. Passages of at least 50 words lie in nodes that span ``WIDTH`` = 46 shingles or more; those are
read off the sliding minima of that width (a node is the minimum of a run of windows, and the run gives
l and r, cut at WIDTH - 1 places from c), so a text of n shingles has about 2n / 47 of them.

1. Windows of ``HASHES`` functions are emitted with the hash of their minimum as key.
2. Keys that occur in two documents survive. A key may join passages that only share a phrase, so its
   windows are split by the min-hash of the 23 shingles left, again of those right of c (one of both lies
   inside any shared passage), and again by both. The smallest (document, place) of each part is its owner, and the
   other windows are matched with the owner: m windows give m - 1 matches, never all pairs. Frequent
   keys, found on a sample, are salted; the owners that each salt has are then matched with the first of
   them. A frequent key that the sample misses is only less evenly dealt.
3. Interval join: the matches of a document with an owner document whose windows overlap at about the
   same distance form a run. Runs are candidates where ``ENOUGH`` hash functions give matches, with
   whatever owners.
4. The shingles of candidate runs are fetched from the texts once, in chunks that all runs share, and
   each run is verified on its own: the best scoring stretches with a Jaccard similarity of at least 0.8
   and at least 50 words are returned.
5. An owner that holds only a phrase of a passage hides it. So stretches of 50 words whose windows under all
   hash functions are shared, and which no passage covers, are compared by the hash of their whole content
   and verified like the others. Exact repeats are found whatever other documents hold parts of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.llm.words import Words, mix, shingles, text_batches
from auger.session import drop_scratch, write_scratch

SHINGLE, WORDS, THRESHOLD = 5, 50, 0.8
WIDTH = WORDS - SHINGLE + 1
HALF = WIDTH // 2
HASHES, ENOUGH = 4, 2
CHUNK = 64
SAMPLE, LEAST_HOT, HOT_SHARE, MAX_HOT, SALTS = 32, 16, 64, 10_000, 32  # keys in 1/64 of the sampled documents are hot
DOC = "struct<id:bigint,text_key:bigint>"  # a document: id (nulls first) and the hash of its text
SIDES = ("l", "r", "b")  # left, right, both

_SEEDS = mix(np.arange(101, 102 + HASHES, dtype=np.uint64))
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    if n < width:
        return v[:0]
    block = np.concatenate([v, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1:n])


def compact_windows(s: np.ndarray, off: np.ndarray):
    """For each hash function: key, text number, place (see ``_place``) and context of each window."""
    n = len(s)
    if n < WIDTH:
        return
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    begin, end = off[:-1][owner], off[1:][owner]
    places = np.arange(n)
    at = np.flatnonzero(places[: n - WIDTH + 1] + WIDTH <= end[: n - WIDTH + 1])
    if not len(at):
        return
    around = _sliding_min(mix(s ^ _SEEDS[HASHES]), HALF)
    for j in range(HASHES):
        v = mix(s ^ _SEEDS[j])
        low = (_sliding_min((v & ~_LOW) | (places.astype(np.uint64) & _LOW), WIDTH)[at] & _LOW).astype(np.int64)
        c = at + ((low - at) & int(_LOW))
        new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        left, right = at[new], at[np.append(new[1:] - 1, len(at) - 1)] + WIDTH - 1
        c = c[new]
        ok_l, ok_r = c - HALF + 1 >= begin[c], c + HALF <= end[c]
        ctx_l = np.where(ok_l, around[np.maximum(c - HALF + 1, 0)] >> np.uint64(32), np.uint64(0))
        ctx_r = np.where(ok_r, around[np.minimum(c, len(around) - 1)] >> np.uint64(32), np.uint64(0))
        place = ((c - begin[c]) << 15) | ((c - left) << 9) | ((right - c) << 3) | j
        yield mix(v[c] + np.uint64(j)), owner[c], place, (ctx_l << np.uint64(32)) | ctx_r


def _place(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """place -> c, l, r, hash function"""
    c = p >> 15
    return c, c - ((p >> 9) & 63), c + ((p >> 3) & 63), p & 7


def _emit(batches):
    for batch in batches:
        for b in text_batches(batch):
            words = Words(b.column("text").to_pylist())
            doc = b.column("doc")
            for key, owner, place, around in compact_windows(*shingles(words.hash, words.off, SHINGLE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), doc.take(pa.array(owner)), pa.array(place), pa.array(around.view(np.int64))],
                    names=["key", "doc", "place", "around"])


def _windows(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "text").mapInArrow(_emit, f"key long, doc {DOC}, place long, around long")


def _matches(docs: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """doc, place, odoc, oplace: windows and their owners in another document. The table that the result
    reads is added to ``scratch``."""
    sample = docs.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(SAMPLE)) == 0)
    often = max(LEAST_HOT, sample.select("doc").count() // HOT_SHARE)
    hot = (_windows(sample).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)
           .orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key", F.lit(SALTS).alias("salts")))
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc"), F.lit(SALTS)) + 1)
    group = Window.partitionBy("key", "salt")
    seen = (_windows(docs).join(F.broadcast(hot), "key", "left")  # MAX_HOT rows at most
            .withColumn("salt", salt).drop("salts")
            .withColumn("least", F.min("doc").over(group)).withColumn("most", F.max("doc").over(group))
            .where("least < most or salt > 0")
            .withColumn("l", F.shiftrightunsigned("around", 32)).withColumn("r", F.col("around").bitwiseAND((1 << 32) - 1))
            .withColumn("b", F.when((F.col("l") != 0) & (F.col("r") != 0), F.col("around")).otherwise(0)))
    for side in SIDES:
        alike = Window.partitionBy("key", "salt", side)
        owner = F.min(F.struct("doc", "place")).over(alike)
        seen = seen.withColumn(f"o{side}", F.when(F.col(side) != 0, owner))
    foreign = F.array_distinct(F.filter(F.array(*[f"o{x}" for x in SIDES]), lambda o: o["doc"] != F.col("doc")))
    # of a salted key, each salt has owners of its own; the windows of these documents alone meet over all salts
    heads = [F.when((F.col("salt") > 0) & (F.col(f"o{x}.doc") == F.col("doc")), F.xxhash64("key", x, F.lit(x))) for x in SIDES]
    seen = write_scratch(seen.select("doc", "place", foreign.alias("owners"), F.array_compact(F.array(*heads)).alias("heads"))
                         .where("size(owners) > 0 or size(heads) > 0"), "windows")
    scratch.append(seen)
    near = seen.select("doc", "place", F.explode("owners").alias("o")).select(
        "doc", "place", F.col("o.doc").alias("odoc"), F.col("o.place").alias("oplace"))
    met = seen.select("doc", "place", F.explode("heads").alias("head"))  # SALTS documents of a head at most
    owners = (met.groupBy("head").agg(F.min(F.struct("doc", "place")).alias("m"), F.max("doc").alias("most"))
              .where("m.doc < most").select("head", F.col("m.doc").alias("odoc"), F.col("m.place").alias("oplace")))
    owners = write_scratch(owners, "owners")  # so that both sides of the join are plain shuffles, which Spark splits
    scratch.append(owners)
    return near.unionAll(met.join(owners, "head").select("doc", "place", "odoc", "oplace").where("doc != odoc"))


def _supported(start: np.ndarray, end: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run (rows from ``at`` on): do ``ENOUGH`` hash functions match in the overlapping windows of
    the document that it lies in?"""
    order = np.argsort(start, kind="stable")
    reach = np.maximum.accumulate(end[order])
    region = np.empty(len(start), dtype=np.int64)
    region[order] = np.concatenate(([0], np.cumsum(start[order][1:] > reach[:-1])))
    enough = sum((np.bincount(region[j == k], minlength=region.max() + 1) > 0).astype(int) for k in range(HASHES)) >= ENOUGH
    return enough[region[at]]


def _numbers(docs: pa.StructArray) -> np.ndarray:
    """For each document its rank among them."""
    null = docs.field(0).is_null().to_numpy(zero_copy_only=False)
    both = np.stack([~null, docs.field(0).fill_null(0).to_numpy(), docs.field(1).to_numpy()], axis=1).astype(np.int64)
    return np.unique(both, axis=0, return_inverse=True)[1].ravel()


def _runs(batches):
    for b in batches:
        for i, group in enumerate(b.column("m")):
            flat = group.values
            place, oplace = flat.field(0).to_numpy(), flat.field(2).to_numpy()
            odocs = flat.field(1)
            odoc = _numbers(odocs)
            c, left, right, j = _place(place)
            oc, oleft, oright, _ = _place(oplace)
            shift = c - oc
            start, end = np.maximum(left, oleft + shift), np.minimum(right, oright + shift)
            order = np.lexsort((start, odoc))
            odocs, odoc, start, end, shift, j = odocs.take(pa.array(order)), odoc[order], start[order], end[order], shift[order], j[order]
            part = np.concatenate(([0], np.cumsum(odoc[1:] != odoc[:-1])))
            reach = np.maximum.accumulate(end + part * (1 << 40)) - part * (1 << 40)
            cut = np.concatenate(([True], (part[1:] != part[:-1]) | (start[1:] > reach[:-1] + 1) | (np.abs(np.diff(shift)) > WIDTH)))
            at = np.flatnonzero(cut)
            keep = _supported(start, end, j, at)
            lo, hi = np.minimum.reduceat(start, at)[keep], np.maximum.reduceat(end, at)[keep]
            olo, ohi = np.minimum.reduceat(start - shift, at)[keep], np.maximum.reduceat(end - shift, at)[keep]
            # windows of one passage may have several owners, so look beyond those of this one
            lo, hi, olo, ohi = np.maximum(lo - WIDTH, 0), hi + WIDTH, np.maximum(olo - WIDTH, 0), ohi + WIDTH
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(np.full(len(lo), i))), odocs.take(pa.array(at[keep])), *map(pa.array, (lo, hi, olo, ohi))],
                names=["doc", "odoc", "lo", "hi", "olo", "ohi"])


def _fetch(batches):
    for batch in batches:
        for b in text_batches(batch):
            words = Words(b.column("text").to_pylist())
            s, off = shingles(words.hash, words.off, SHINGLE)
            s = (s >> np.uint64(32)).astype(np.uint32)
            rows, numbers, parts = [], [], []
            for i, wanted in enumerate(b.column("chunks").to_pylist()):
                for k in wanted:
                    part = s[off[i] + k * CHUNK:min(off[i] + (k + 1) * CHUNK, off[i + 1])]
                    if len(part):
                        rows.append(i)
                        numbers.append(k)
                        parts.append(part.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(at), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())],
                names=["doc", "chunk", "part"])


PENALTIES = (2.0, 4.0, 8.0)


def stretches(own: np.ndarray, other: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """Stretches (start, end, other start, other end, similarity) of ``own`` that occur in ``other``, which
    runs along it; ends are exclusive. The stretch of best score (a shingle that occurs there counts 1,
    another minus a penalty) is taken if the Jaccard similarity of its two sets reaches the threshold;
    if not, better matching parts of it are sought under the next penalty. What lies beside it is
    searched in the same way."""
    if len(own) < WIDTH:
        return []
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    at = np.searchsorted(ranked, own)
    hit = (at < len(ranked)) & (ranked[np.minimum(at, len(ranked) - 1)] == own)
    scores = [np.concatenate(([0.0], np.cumsum(np.where(hit, 1.0, -p)))) for p in PENALTIES]

    def near(i: int) -> int:
        lo, hi = np.searchsorted(ranked, own[i]), np.searchsorted(ranked, own[i], side="right")
        where = order[lo:hi]
        return int(where[np.abs(where - i).argmin()])

    out, todo = [], [(0, len(own), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a < WIDTH:
            continue
        part = scores[level][a:b + 1]
        gain = part - np.minimum.accumulate(part)
        y = int(gain.argmax())
        x = int(part[:y + 1].argmin())
        if y - x < 1:
            continue
        if y - x >= WIDTH:
            oa, ob = near(a + x), near(a + y - 1) + 1
            mine, theirs = np.unique(own[a + x:a + y]), np.unique(other[min(oa, ob - 1):max(ob, oa + 1)])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            similarity = both / (len(mine) + len(theirs) - both)
            if similarity >= threshold:
                out.append((a + x, a + y, min(oa, ob - 1), max(ob, oa + 1), similarity))
            elif level + 1 < len(PENALTIES):
                todo.append((a + x, a + y, level + 1))
            else:  # words missing here split the other side: cut at the largest of these gaps
                hits = a + x + np.flatnonzero(hit[a + x:a + y])
                gaps = np.abs(np.diff(order[at[hits]] - hits))
                if len(gaps) and gaps.max():
                    cut = int(hits[gaps.argmax() + 1])
                    todo += [(a + x, cut, 0), (cut, a + y, 0)]
        todo += [(a, a + x, level), (a + y, b, level)]
    return sorted(out)


def _join_parts(parts: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(p["part"] for p in sorted(parts, key=lambda p: p["chunk"])), dtype=np.uint32)


def _verify(batches):
    names = ["doc_id", "text_key", "start_word", "end_word", "other_doc", "other_start", "other_end", "similarity"]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            first, ofirst = r["lo"] // CHUNK * CHUNK, r["olo"] // CHUNK * CHUNK
            own = _join_parts(r["mine"])[r["lo"] - first:r["hi"] + 1 - first]
            other = _join_parts(r["theirs"])[r["olo"] - ofirst:r["ohi"] + 1 - ofirst]
            for x, y, ox, oy, similarity in stretches(own, other):
                rows.append((r["doc"]["id"], r["doc"]["text_key"], r["lo"] + x, r["lo"] + y + SHINGLE - 1, r["odoc"]["id"],
                             r["olo"] + ox, r["olo"] + oy + SHINGLE - 1, similarity))
        cols = list(zip(*rows)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(cols, names)], names=names)


RUN = f"doc {DOC}, odoc {DOC}, lo long, hi long, olo long, ohi long"


def _open_stretches(batches):
    """Per document the starts (from, to) of stretches of ``WIDTH`` shingles that share their window with
    another document under every hash function, and that no passage of the document covers yet."""
    for b in batches:
        rows = []
        for i, (places, spans) in enumerate(zip(b.column("places"), b.column("spans").to_pylist())):
            c, left, right, j = _place(places.values.to_numpy())
            n = int(right.max()) - WIDTH + 3
            shared = np.ones(n, dtype=bool)
            for k in range(HASHES):
                steps = np.bincount(left[j == k], minlength=n).astype(np.int64)
                steps[:n] -= np.bincount(right[j == k] - WIDTH + 2, minlength=n)
                shared &= np.cumsum(steps[:n]) > 0
            for s in spans or ():
                shared[s["start_word"]:max(s["end_word"] - WORDS + 1, s["start_word"])] = False
            edge = np.diff(np.concatenate(([0], shared.view(np.int8), [0])))
            ranges = [{"lo": x, "hi": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
            if ranges:
                rows.append((i, ranges))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc").take(pa.array([i for i, _ in rows], pa.int64())),
             pa.array([r for _, r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["doc", "open"])


def _stretch_hashes(batches):
    """The hash of the whole content of each open stretch."""
    for batch in batches:
        for b in text_batches(batch):
            words = Words(b.column("text").to_pylist())
            s, off = shingles(words.hash, words.off, SHINGLE)
            for i, ranges in enumerate(b.column("open").to_pylist()):
                mine = s[off[i]:off[i + 1]]
                if len(mine) < WIDTH:
                    continue
                at = np.concatenate([np.arange(r["lo"], min(r["hi"], len(mine) - WIDTH + 1)) for r in ranges])
                content = np.zeros(len(at), dtype=np.uint64)
                for k in range(WIDTH):
                    content = mix(content + mine[at + k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(content.view(np.int64)), b.column("doc").take(pa.array(np.full(len(at), i))), pa.array(at)],
                    names=["content", "doc", "at"])


def _exact_runs(batches):
    for b in batches:
        for i, group in enumerate(b.column("m")):
            flat = group.values
            at, odocs, oat = flat.field(0).to_numpy(), flat.field(1), flat.field(2).to_numpy()
            odoc = _numbers(odocs)
            order = np.lexsort((at, at - oat, odoc))
            odoc, at, oat, odocs = odoc[order], at[order], oat[order], odocs.take(pa.array(order))
            cut = np.flatnonzero(np.concatenate(([True], (odoc[1:] != odoc[:-1]) | (np.diff(at - oat) != 0) | (np.diff(at) > WIDTH))))
            last = np.append(cut[1:], len(at)) - 1
            lo, hi, olo, ohi = (np.maximum(at[cut] - WIDTH, 0), at[last] + 2 * WIDTH, np.maximum(oat[cut] - WIDTH, 0), oat[last] + 2 * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(np.full(len(cut), i))), odocs.take(pa.array(cut)), *map(pa.array, (lo, hi, olo, ohi))],
                names=["doc", "odoc", "lo", "hi", "olo", "ohi"])


def _exact(docs: DataFrame, seen: DataFrame, passages: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Runs of exactly equal stretches that the first owners hide: a document of a smaller id that shares only a
    phrase owns their windows. Equal contents are transitive, so one owner for each is enough."""
    # windows with an owner elsewhere, and those owners; of salted keys, owners have met over all salts and are among the first
    places = (seen.select(F.explode(F.array_append("owners", F.struct("doc", "place"))).alias("w")).select("w.doc", "w.place")
              .groupBy("doc").agg(F.collect_set("place").alias("places")))  # a document's windows
    spans = passages.groupBy(F.struct(F.col("doc_id").alias("id"), "text_key").alias("doc")).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("spans"))  # a document's passages
    # ids may be null: the struct is never, and joins as a whole
    todo = (places.join(spans, places["doc"].eqNullSafe(spans["doc"]), "left").select(places["doc"], "places", "spans")
            .mapInArrow(_open_stretches, f"doc {DOC}, open array<struct<lo:bigint,hi:bigint>>"))
    hashes = write_scratch(docs.join(todo, "doc").select("doc", "text", "open")
                           .mapInArrow(_stretch_hashes, f"content long, doc {DOC}, at long"), "contents")
    scratch.append(hashes)
    owners = write_scratch(hashes.groupBy("content").agg(F.min(F.struct("doc", "at")).alias("m"), F.max("doc").alias("most"))
                           .where("m.doc < most").select("content", F.col("m.doc").alias("odoc"), F.col("m.at").alias("oat")), "content-owners")
    scratch.append(owners)
    met = hashes.join(owners, "content").where("doc != odoc").groupBy("doc").agg(
        F.collect_set(F.struct("at", "odoc", "oat")).alias("m"))  # a document's stretches
    return met.mapInArrow(_exact_runs, RUN)


def _verified(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The passages of candidate runs (a written table)."""
    pieces = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CHUNK), F.floor(F.col(hi) / CHUNK)))
    mine = runs.select("run", "doc", pieces("lo", "hi").alias("chunk"))
    theirs = runs.select("run", F.col("odoc").alias("doc"), pieces("olo", "ohi").alias("chunk"))
    wanted = (mine.select("doc", "chunk").unionAll(theirs.select("doc", "chunk")).distinct()
              .groupBy("doc").agg(F.collect_list("chunk").alias("chunks")))  # a document's chunks
    chunks = write_scratch(docs.join(wanted, "doc").mapInArrow(_fetch, f"doc {DOC}, chunk long, part binary")
                           .dropDuplicates(["doc", "chunk"]), "chunks")
    side = lambda rows, name: (rows.join(chunks, ["doc", "chunk"]).groupBy("run")
                               .agg(F.collect_list(F.struct("chunk", "part")).alias(name)))
    whole = runs.join(side(mine, "mine"), "run").join(side(theirs, "theirs"), "run")
    out = whole.mapInArrow(_verify, "doc_id long, text_key long, start_word long, end_word long, other_doc long, "
                                    "other_start long, other_end long, similarity double").distinct()
    out = write_scratch(out, "passages")
    drop_scratch(chunks)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per verified passage: ``doc_id, text_key, start_word, end_word, other_doc, other_start,
    other_end, similarity``. Words ``start_word`` to ``end_word`` (exclusive) of the document repeat words
    ``other_start`` to ``other_end`` of ``other_doc``, a smaller document (id, then hash of the text), which keeps them.

    ``docs``: ``doc_id``, ``text``; other columns are ignored. Null texts and texts of fewer than 50 words
    have no passage. Rows with equal ids and texts count as one document, in which repeats are not looked
    for; rows with one id (or null ids, which come before all others) and different texts are documents of
    their own, ordered by ``text_key``, the hash of the text. Repeated rows give their passages once."""
    docs = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key")).alias("doc"), "text")
    used: list[DataFrame] = []
    matches = _matches(docs, used)
    number = F.monotonically_increasing_id()
    found = matches.groupBy("doc").agg(F.collect_set(F.struct("place", "odoc", "oplace")).alias("m"))  # a document's windows
    runs = write_scratch(found.mapInArrow(_runs, RUN).withColumn("run", number), "runs")
    near = _verified(docs, runs)
    more = write_scratch(_exact(docs, used[0], near, used).withColumn("run", number), "exact-runs")
    for t in [runs, *used]:
        drop_scratch(t)
    exact = _verified(docs, more)
    drop_scratch(more)
    out = write_scratch(near.unionAll(exact).distinct(), "all-passages")
    drop_scratch(near)
    drop_scratch(exact)
    return out


def _cut(batches):
    for batch in batches:
        for b in text_batches(batch):
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("__spans").to_pylist()):
                if spans:
                    words = Words([texts[i]])
                    gone = np.zeros(len(words.hash) + 1, dtype=bool)
                    for s in spans:
                        gone[s["start_word"]:s["end_word"]] = True
                    edge = np.diff(np.concatenate(([0], gone.view(np.int8))))
                    kept, at = [], 0
                    for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                        kept.append(texts[i][at:words.start[x]])
                        at = words.end[y - 1]
                    texts[i] = "".join(kept) + texts[i][at:]
            names = [n for n in b.schema.names if n not in ("text", "__spans")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())] + [b.column(n) for n in names], names=["text", *names])


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the words of ``passages``: the copy in the smallest document stays.
    ``n_chars``, if there, follows; documents that lose all their words go."""
    spans = passages.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("__spans"))  # a document's passages
    of_doc = docs["doc_id"].cast("long").eqNullSafe(spans["__id"]) & (F.xxhash64(docs["text"]) == spans["__key"])
    joined = docs.join(spans, of_doc, "left").drop("__id", "__key")
    schema = "text string, " + ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    cut = (joined.where("__spans is not null").mapInArrow(_cut, schema)
           .where(F.col("text").rlike(r"[\p{L}\p{N}_]")))  # nothing else is left of some
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    names = [F.col(f"`{n}`") for n in docs.columns]
    return joined.where("__spans is null").select(names).unionByName(cut.select(names))
