"""Connected components of large graphs by alternating large-star and small-star steps.

The least neighbours of a step are checkpointed before they are joined to the edges: both sides of the join are then dealt for it,
and a node with very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Rounds after which the algorithm would have joined a path of more nodes than a table can hold.
MOST_ROUNDS = 60


#: Edges that one partition of a step holds, about.
PART_EDGES = 100_000


def _kept(frame: DataFrame, edges: int) -> DataFrame:
    """Checkpointed, in no more partitions than that many edges fill: a step over few edges is few tasks and files."""
    return frame.coalesce(max(1, -(-edges // PART_EDGES))).checkpoint()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component. Each round is checkpointed."""
    scratch.shared_dir(edges.sparkSession)
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = now.union(now.select("v", "u"))
        least = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * mark[0])
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _kept(large.groupBy("u").agg(F.min("v").alias("m")), 2 * mark[0])
        joined = large.join(low, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        then = _kept(small.distinct(), 2 * mark[0])
        new = _mark(then)
        now, same = then, new == mark
        mark = new
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
