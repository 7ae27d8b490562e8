"""Relationship graph by breadth-first search over references and conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import items, text
from ..session import checkpoint

KINDS = {"attachment": "attachments", "related": "related", "mention": "mentions"}
EDGES = "from_id string, kind string, reference string, neighbor_id string, depth int"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # id
    edges: DataFrame  # from_id, kind, reference, neighbor_id, depth


def related(docs: DataFrame, start: str, depth: int = 1, at_a_time: bool = True) -> Graph:
    """The graph around ``start``, an id or else a bn; an unknown start gives an empty graph.

    One edge for each occurrence of a reference, resolved or not; conversation
    edges lead to every member of the thread, the document itself included. Only
    documents seen for the first time are expanded in the next hop. Of several
    documents with one bn the smallest id is meant. Duplicate rows count once.
    """
    depth = max(1, min(3, depth))
    base = docs.dropDuplicates(["id"]).select("id", text("bn").alias("bn"), text("conversation").alias("conversation"), *[items(c).alias(c) for c in KINDS.values()])
    by_bn = base.where(F.col("bn").isNotNull()).groupBy("bn").agg(F.min("id").alias("neighbor_id"))
    first = base.where(F.col("id") == start).select("id")
    first = first.unionByName(base.where((F.col("bn") == start)).agg(F.min("id").alias("id")).where(F.col("id").isNotNull())).withColumn("k", (F.col("id") == start).cast("int"))
    frontier = first.orderBy(F.desc("k")).limit(1).select("id")
    origin = visited = frontier
    edges = None
    for hop in range(1, depth + 1):
        rows = base.join(frontier, "id", "left_semi")
        listed = rows.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("refs")) for k, c in KINDS.items()])).alias("e"))
        refs = listed.select(F.col("id").alias("from_id"), F.col("e.kind").alias("kind"), F.explode("e.refs").alias("reference"))
        named = refs.join(by_bn, refs["reference"] == by_bn["bn"], "left").select("from_id", "kind", "reference", "neighbor_id")
        threads = rows.where(F.col("conversation").isNotNull()).select(F.col("id").alias("from_id"), F.col("conversation").alias("reference"))
        members = base.where(F.col("conversation").isNotNull()).select(F.col("conversation").alias("reference"), F.col("id").alias("neighbor_id"))
        threaded = threads.join(members, "reference").select("from_id", F.lit("conversation").alias("kind"), "reference", "neighbor_id")
        found = named.unionByName(threaded).withColumn("depth", F.lit(hop))
        edges = found if edges is None else edges.unionByName(found)
        if hop < depth:
            frontier = found.where(F.col("neighbor_id").isNotNull()).select(F.col("neighbor_id").alias("id")).distinct().join(visited, "id", "left_anti")
            if at_a_time:
                frontier = checkpoint(frontier)
            visited = visited.unionByName(frontier)
    nodes = origin.unionByName(edges.where(F.col("neighbor_id").isNotNull()).select(F.col("neighbor_id").alias("id"))).distinct()
    return Graph(nodes, edges)
