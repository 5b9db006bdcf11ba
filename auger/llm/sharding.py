"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows are dealt to ``n_blocks`` source blocks, and that deal is written down, so every later job and
   every retry of a task sees the same rows in the same block.
2. The matrix "block b sends a[b][s] rows to shard s" is drawn from its exact law (what a uniform
   permutation of all rows would give): block by block, shard by shard, each entry is hypergeometric
   given the rows and places still left. Only the block counts are on the driver, ``n_blocks`` numbers.
3. Inside a block the rows are permuted (random 128-bit order); the first a[b][0] go to shard 0, the
   next a[b][1] to shard 1, and so on: the exchange.
4. Inside a shard the rows are permuted again. A shard is cut into ranges of the random key first, the
   range counts are summed up, and each range is ordered by its own task, so no task holds a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auger.session import write_scratch

N_BLOCKS = 1024


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """How many of ``good`` marked among ``total`` are in ``draws`` taken without return.

    Inversion of the law summed over its support, cut 40 standard deviations from the mode (what lies
    beyond has less weight than a double can show); any size of the numbers."""
    lo, hi = max(0, good + draws - total), min(good, draws)
    if lo == hi:
        return lo
    p = good / total
    sd = (draws * p * (1 - p) * max(total - draws, 0) / max(total - 1, 1)) ** 0.5
    mode = int((good + 1) * (draws + 1) / (total + 2))
    lo, hi = max(lo, int(mode - 40 * sd) - 40), min(hi, int(mode + 40 * sd) + 40)
    k = np.arange(lo, hi, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(total - good - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; row sums ``block_rows``, column sums ``shard_rows``."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    out = []
    for rows in block_rows:
        total, row = sum(left), []
        for s, places in enumerate(left):
            n = hypergeometric(rng, places, total, rows)
            row.append(n)
            total -= places
            rows -= n
            left[s] = places - n
        out.append(row)
    return out


def shard(df: DataFrame, n_shards: int, seed: int = 0, n_blocks: int = N_BLOCKS, n_ranges: int = 64) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1; counts at most one apart, the first shards get the
    odd rows) and ``slot`` (0, 1, ... without gaps in each shard).

    Every row is kept once, nulls and repeated rows too; an empty table gives an empty result. Columns
    of ``df`` named ``shard`` or ``slot`` are replaced. All of ``df`` is written once to the shared
    folder, so pass only the columns that are wanted."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("shard", "slot")
    at = F.monotonically_increasing_id()
    dealt = write_scratch(df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.xxhash64(at, F.lit(seed)).alias("r1"), F.xxhash64(at, F.lit(seed), F.lit("second")).alias("r2")), "shard-deal")
    block = F.pmod(F.xxhash64("r2", "r1"), F.lit(n_blocks)).cast("int")
    counts = {b: n for b, n in dealt.groupBy(block.alias("b")).count().collect()}  # at most n_blocks rows
    blocks, total = sorted(counts), sum(counts.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    sent = communication_matrix([counts[b] for b in blocks], sizes, seed)
    ends = [(b, [int(x) for x in np.cumsum(row)]) for b, row in zip(blocks, sent)]
    spark = df.sparkSession
    matrix = spark.createDataFrame(ends, "block int, ends array<long>")  # n_blocks x n_shards numbers
    in_block = Window.partitionBy("block").orderBy("r1", "r2")
    exchanged = write_scratch(
        dealt.withColumn("block", block).withColumn("rank", F.row_number().over(in_block))
        .join(F.broadcast(matrix), "block")
        .select("row", "r1", "r2", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"),
                F.pmod(F.xxhash64("r1", F.lit("range")), F.lit(n_ranges)).cast("int").alias("range")), "shard-sent")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (exchanged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))  # n_shards x n_ranges rows
              .select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    in_range = Window.partitionBy("shard", "range").orderBy("r2", "r1")
    return (exchanged.withColumn("rank", F.row_number().over(in_range))
            .join(F.broadcast(starts), ["shard", "range"])
            .select("row.*", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")))
