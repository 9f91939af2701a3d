"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: each node ties its larger neighbours to the least of its
    neighbourhood; small star: its smaller neighbours and itself. Minima are combined before the
    shuffle and joined back, so a node with many neighbours is no group in one task."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = both.join(least, "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, label (the least node of its component) for every node that has an edge (a, b). Each
    round is stored; the rounds end when the edges, which then are stars, stay the same."""
    now = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = staged(_star(_star(now, True), False))
        new = tuple(now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
