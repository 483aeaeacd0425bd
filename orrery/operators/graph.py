"""Depth-bounded searches and orders of directed graphs.

A search expands each node once, at its least depth, and emits every edge of the nodes it expands, those back to nodes already
seen included. Null ends lead nowhere, an unknown root finds nothing, parallel edges are all kept, and a repeated root counts once.
Frontiers are small beside the edges, so each step joins the frontier to the edges and stops when nothing new is
found. Steps are checkpointed, not cached on executors, so that a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folders
from . import relational

MOST_DEPTH = 10
#: Rows of a frontier up to which it is sent to every executor.
BROADCAST_ROWS = 100_000


def _kept(frame: DataFrame) -> DataFrame:
    """Checkpointed in the cluster's shared folder."""
    folders.shared(frame.sparkSession)
    return frame.checkpoint()


def search(edges: DataFrame, roots: DataFrame, depth: int, source: str = "source_id", target: str = "target_id", root: str = "id") -> DataFrame:
    """Edges within `depth` steps of any root, each once, with the depth (from 1) at which their source was expanded."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}")
    seen = frontier = _kept(roots.select(F.col(root).alias("node")).distinct())
    out = edges.limit(0).withColumn("depth", F.lit(0))
    for step in range(1, depth + 1):
        size = frontier.count()
        if not size:
            break
        small = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        found = _kept(edges.join(small, edges[source] == frontier["node"], "left_semi"))
        out = out.unionByName(found.withColumn("depth", F.lit(step)))
        frontier = _kept(found.select(F.col(target).alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.union(frontier)
    return out


def search_many(edges: DataFrame, roots: DataFrame, depth: int, source: str = "source_id", target: str = "target_id", root: str = "id") -> DataFrame:
    """(root, edge columns, depth): what `search` finds from each root by itself, all roots at once, in as many steps as `depth`.

    Roots are numbered, and a node carries the roots that have reached it as bits of long numbers, 64 roots in each; bits that meet in a node are
    combined, so an edge is joined once for 64 roots. Null roots lead nowhere.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}")
    distinct = roots.select(F.col(root).alias("root")).where("root is not null").distinct()
    # numbers by the partition and the place in it: nothing is sorted in one task
    numbered = _kept(distinct.withColumn("number", F.monotonically_increasing_id()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(64)).cast("int"))
    group = F.shiftright("number", 6).alias("group")
    seen = frontier = _kept(numbered.select(F.col("root").alias("node"), group, bit.alias("bits")).groupBy("node", "group").agg(F.bit_or("bits").alias("bits")))
    out = edges.limit(0).select(F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("bits"), "*", F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        size = frontier.count()
        if not size:
            break
        small = relational.side(frontier, size <= BROADCAST_ROWS)
        found = _kept(edges.join(small, edges[source] == frontier["node"]).select("group", "bits", *edges.columns))
        out = out.unionByName(found.withColumn("depth", F.lit(step)))
        if step == depth:
            break  # no step needs what the last one reached
        reached = found.select(F.col(target).alias("node"), "group", "bits").where("node is not null").groupBy("node", "group").agg(F.bit_or("bits").alias("bits"))
        both = seen.select("node", "group", F.col("bits").alias("old")).join(reached, ["node", "group"], "full_outer").withColumns({"old": F.coalesce("old", F.lit(0)), "bits": F.coalesce("bits", F.lit(0))})
        both = _kept(both.select("node", "group", F.col("old").bitwiseOR(F.col("bits")).alias("all"), F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("new")))
        seen, frontier = both.select("node", "group", F.col("all").alias("bits")), both.where("new <> 0").select("node", "group", F.col("new").alias("bits"))
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    spread = out.withColumn("__bit", F.explode(ones)).withColumn("number", F.shiftleft("group", 6) + F.col("__bit")).drop("group", "bits", "__bit")
    return spread.join(relational.side(numbered, numbered.count() <= BROADCAST_ROWS), "number").select("root", *edges.columns, "depth")


def downstream(edges: DataFrame, roots: DataFrame, depth: int = 2, source: str = "source_id", target: str = "target_id") -> DataFrame:
    return search(edges, roots, depth, source, target)


def upstream(edges: DataFrame, roots: DataFrame, depth: int = 2, source: str = "source_id", target: str = "target_id") -> DataFrame:
    return search(edges, roots, depth, target, source)


def connected(edges: DataFrame, roots: DataFrame, depth: int = 3, key: str = "id", source: str = "source_node_id", target: str = "target_node_id") -> DataFrame:
    """Edges reached downstream or upstream (two directed searches), each once."""
    both = downstream(edges, roots, depth, source, target).unionByName(upstream(edges, roots, depth, source, target))
    return both.drop("depth").dropDuplicates([key])


def chain(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """The connected edges of a node, and the nodes on them, the root always among them."""
    one = nodes.sparkSession.range(1).select(F.lit(root).alias("id"))
    found = connected(edges, one, depth)
    ids = found.select(F.col("source_node_id").alias("id")).union(found.select(F.col("target_node_id").alias("id"))).union(one).distinct()
    return found, nodes.join(ids, "id", "left_semi")


def stats(edges: DataFrame, source: str, target: str, total_nodes: int | None = None) -> DataFrame:
    """edges, connected nodes, and nodes without an edge if the total is known."""
    ends = edges.select(F.col(source).alias("n")).union(edges.select(F.col(target).alias("n"))).distinct()
    out = edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(ends.agg(F.count(F.lit(1)).alias("connected_nodes")))
    return out if total_nodes is None else out.withColumn("orphan_nodes", F.lit(total_nodes).cast("long") - F.col("connected_nodes"))


# --- stage graphs ---------------------------------------------------------------------------------------------------


def stage_edges(stages: DataFrame) -> DataFrame:
    """An edge from each stage that another depends on to that other."""
    return stages.select(F.explode("dependsOn").alias("from"), F.col("id").alias("to"), F.lit("sequential").alias("relation"))


def topological_levels(stages: DataFrame) -> DataFrame:
    """(id, level): stages by how many stages come before them at least; stages on or behind a cycle are missing.

    Stages of a level may be as many as all stages, so every join is by sorting: none is sent to the driver and all executors.
    """
    edges = _kept(stage_edges(stages).join(stages.select(F.col("id").alias("from")).hint("merge"), "from", "left_semi"))
    left = _kept(stages.select("id").distinct())
    done = left.limit(0).withColumn("level", F.lit(0))
    level = 0
    while not left.isEmpty():
        held = edges.join(left.withColumnRenamed("id", "from").hint("merge"), "from", "left_semi").select(F.col("to").alias("id")).distinct()
        free = _kept(left.join(held.hint("merge"), "id", "left_anti"))
        if free.isEmpty():
            break
        done = done.unionByName(free.withColumn("level", F.lit(level)))
        left = _kept(left.join(free.hint("merge"), "id", "left_anti"))
        level += 1
    return done


def is_acyclic(stages: DataFrame) -> bool:
    return topological_levels(stages).count() == stages.select("id").distinct().count()


def reachable(stages: DataFrame, stage: str, down: bool) -> DataFrame:
    """Ids of all stages that come after (down) or before the given one."""
    edges = stage_edges(stages)
    start = stages.sparkSession.range(1).select(F.lit(stage).alias("id"))
    a, b = ("from", "to") if down else ("to", "from")
    seen = frontier = _kept(start)
    while not frontier.isEmpty():
        frontier = _kept(edges.join(frontier, edges[a] == frontier["id"], "left_semi").select(F.col(b).alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.union(frontier)
    return seen.where(F.col("id") != stage)


#: How a tree marks calls that are more than plain ones (fixed values).
EDGE_MARKS = {"construct": " [new]", "static_call": " [static]"}


def tree(edges: Sequence[tuple[str, ...]], root: str, depth: int, names: dict[str, str] | None = None) -> str:
    """A drawing of the edges (from, to, and their type if it is known) below a node; a node already on the way is marked, and not
    followed again. Of several edges between two nodes the first one's type is told."""
    names = names or {}
    below: dict[str, dict[str, str]] = {}
    for a, b, *kind in edges:
        below.setdefault(a, {}).setdefault(b, EDGE_MARKS.get(kind[0], "") if kind else "")
    lines = [names.get(root, root)]

    def draw(node: str, lead: str, way: tuple[str, ...]) -> None:
        children = below.get(node, {}) if len(way) <= depth else {}
        for k, child in enumerate(children):
            last = k == len(children) - 1
            again = child in way
            lines.append(f"{lead}{'└── ' if last else '├── '}{names.get(child, child)}{children[child]}{' (circular)' if again else ''}")
            if not again:
                draw(child, lead + ("    " if last else "│   "), (*way, child))

    draw(root, "", (root,))
    return "\n".join(lines)
