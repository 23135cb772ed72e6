"""Connected components by contraction, for edge tables of any size.

Every round, each node points to its smallest neighbour if that is smaller than
itself; edges are rewritten to what their ends point to, and loops and repeats
go. Node ids are hashes, so the smallest neighbour is a random one and the graph
shrinks by a constant factor a round, also on long chains. A node with very
many edges is met in aggregations that combine on the map side and in plain
joins, which Spark splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import Shared


def components(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); nodes of one component share their root."""
    edges = shared.table(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges-0")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(maps)
        ends = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).unionAll(edges.select(F.col("u").alias("node"), F.col("v").alias("to")))
        points = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        points = shared.table(points, f"{name}-points-{k}")
        maps.append(points)
        moved = edges.join(points.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(points.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        edges = shared.table(moved.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-edges-{k + 1}")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0].withColumnRenamed("to", "root")
    for points in maps[1:]:
        out = out.join(points.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return shared.table(out, f"{name}-roots")
