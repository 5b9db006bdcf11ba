"""Connected components of an edge table by contraction, as Spark joins only.

Each round every vertex points at the best of itself and its neighbours, and the graph is contracted
along these pointers; rounds alternate between the order of ids (stars around a smallest id vanish at
once) and a random order (which shrinks any graph by a constant share in the mean). The pointers of all
rounds are then followed from the last to the first. Every round is written to the shared folder, so
lineage stays short; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auger.session import drop_scratch, write_scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id that has an edge to another; ``component`` is the smallest id
    that can be reached. Direction, repeated edges, self loops and null ends do not matter."""
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    graph = write_scratch(pair.distinct(), "edges")
    steps: list[DataFrame] = []
    while not graph.isEmpty():
        n = len(steps)
        rank = (lambda c: F.col(c)) if n % 2 == 0 else (lambda c, n=n: F.xxhash64(F.lit(n), F.col(c)))
        ends = graph.unionAll(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        step = write_scratch(best.select(
            F.col("a").alias("id"), F.when(F.col("m.r") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("to")), "steps")
        steps.append(step)
        left = graph.join(step.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
        both = left.join(step.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        smaller = write_scratch(both.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                                .where("a < b").distinct(), "edges")
        drop_scratch(graph)
        graph = smaller
    if not steps:
        return graph.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("id").alias("to"), F.col("to").alias("end"))
        found = step.join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    found = write_scratch(found, "found")
    for step in steps:
        drop_scratch(step)
    # written, so that both sides of the join are plain shuffles, which Spark splits where a component is large
    smallest = write_scratch(found.groupBy("to").agg(F.min("id").alias("component")), "smallest")
    return found.join(smallest, "to").select("id", "component")
