"""Vertex programs over triplets, in Column form.

A graph is ``vertices(id, state…)``, a row per vertex, and ``edges(src, dst, attributes…)``. A program is given by

- ``initial``: the message that every vertex gets first (None: no vertex gets one),
- ``update``: the new state columns of a vertex that got a message, over its ``id``, its state and ``msg``,
- ``to_dst`` and ``to_src``: the message along an edge, over the edge's columns and the state of both
  ends (``s`` and ``d``, as in ``s.rank``); null sends none,
- ``merge``: the aggregate that makes one ``msg`` of a vertex's messages,
- ``active``: which triplets send: those whose source ("out"), target ("in"), one of both ("either") or
  both ends ("both") got a message in the round before, or all of them ("all"),
- ``accepts``: whether a vertex takes its merged message, over its ``id``, its state and ``msg``; if not, it is as if
  it got none (None: all are taken).

State columns and messages may be of any type, structs included. A vertex without a message keeps its state. The loop
ends when no message was sent, or after ``max_iter`` rounds. Every end of an edge must be a vertex; other
edges send nothing. Vertices with a null id have no edges.

A round shuffles the state (only active vertices where ``active`` allows) to the edges, which lie bucketed by
source and don't move, and what goes along them to the targets. Sources and targets with very many edges are spread
over salts. The new state is written to the shared folder, so plans stay one round deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.operators.messages import EdgeTable
from shopweave.operators.skew import ROWS_PER_SALT, fanned, heavy_keys, salted
from shopweave.session import RoundTables

ACTIVE = {"either": "s_on or d_on", "both": "s_on and d_on", "out": "s_on", "in": "d_on", "all": "true"}


def graph_vertices(edges: DataFrame, **state: Column) -> DataFrame:
    """(id, state…): every end of an edge once, with state columns over ``id``."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", *[c.alias(name) for name, c in state.items()])


def pregel(
    vertices: DataFrame,
    edges: DataFrame,
    update: dict[str, Column],
    merge: Callable[[str], Column],
    to_dst: Column | None = None,
    to_src: Column | None = None,
    initial: Column | None = None,
    active: str = "either",
    reads_target: bool = True,
    max_iter: int | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    accepts: Column | None = None,
    table: EdgeTable | None = None,
) -> DataFrame:
    """(id, state…) after the rounds; ``reads_target=False`` says that no message reads ``d``, which spares its join.

    ``table``: the edges as a table that the caller keeps and closes.
    """
    if active not in ACTIVE:
        raise ValueError(f"unknown side {active!r}")
    if to_dst is None and to_src is None:
        raise ValueError("no message is sent")
    types = {f.name: f.dataType.simpleString() for f in vertices.schema if f.name != "id"}  # every field may be null
    if taken := {"msg", "v", "on"} & set(types):
        raise ValueError(f"names of state columns that a program uses itself: {sorted(taken)}")

    def updated(df: DataFrame) -> Column:
        got = F.col("msg").isNotNull()
        return F.struct(*[(F.when(got, update[c].cast(t)).otherwise(F.col(c).cast(t)) if c in update else F.col(c).cast(t)).alias(c) for c, t in types.items()])

    own = table is None
    table = EdgeTable(edges, rows_per_salt) if own else table
    rounds = RoundTables(vertices.sparkSession, "pregel")
    try:
        meets_target = reads_target or active not in ("out", "all")
        if meets_target:
            heavy_dst = heavy_keys(table.base, "dst", rows_per_salt)
            heavy_dst = edges.sparkSession.createDataFrame(heavy_dst.collect(), heavy_dst.schema)  # at most MAX_HEAVY_KEYS rows
        first = vertices.select("id", *types).withColumn("msg", initial if initial is not None else F.lit(None))
        state = rounds.write((first if initial is None else first.withColumn("now", updated(first))).select("id", (F.struct(*types) if initial is None else F.col("now")).alias("v"), F.lit(True).alias("on")))
        k, n = 0, state.count()
        while max_iter is None or k < max_iter:
            k += 1
            senders = state.select(F.col("id").alias("src"), F.col("v").alias("s"), F.col("on").alias("s_on"))
            triplets = table.triplets(senders.filter("s_on") if active in ("out", "both") else senders, n)
            if meets_target:
                targets = state.select(F.col("id").alias("dst"), F.col("v").alias("d"), F.col("on").alias("d_on"))
                targets = fanned(targets.filter("d_on") if active in ("in", "both") else targets, heavy_dst, "dst")
                triplets = salted(triplets, heavy_dst, "dst", ["src"]).join(targets, ["dst", "_salt"]).drop("_salt")
            triplets = triplets.filter(ACTIVE[active])
            sent = [triplets.select(F.col(end).alias("id"), message.alias("msg")) for end, message in (("dst", to_dst), ("src", to_src)) if message is not None]
            if len(sent) == 2:
                pair = F.array(F.struct(F.col("dst").alias("id"), to_dst.alias("msg")), F.struct(F.col("src").alias("id"), to_src.alias("msg")))
                sent = [triplets.select(F.explode(pair).alias("m")).select("m.id", "m.msg")]
            merged = sent[0].filter("msg is not null").groupBy("id").agg(merge("msg").alias("msg"))
            met = state.select("id", "v.*").join(merged, "id", "left")
            if accepts is not None:
                met = met.withColumn("msg", F.when(accepts, F.col("msg")))
            state = rounds.write(met.select("id", updated(met).alias("v"), F.col("msg").isNotNull().alias("on")))
            if state.filter("on").isEmpty():
                break
    finally:
        rounds.close()
        if own:
            table.close()
    return state.select("id", "v.*")


def out_weight_normalized(edges: DataFrame) -> DataFrame:
    """(src, dst, weight / sum of the source's weights): one round of messages to the source, then the triplets."""
    table = EdgeTable(edges)
    try:
        start = graph_vertices(table.base, out=F.lit(0.0))
        sums = pregel(start, table.base, {"out": F.col("msg")}, F.sum, to_src=F.col("weight").cast("double"), initial=F.lit(0.0), active="out", reads_target=False, max_iter=1, table=table)
        triplets = table.triplets(sums.select(F.col("id").alias("src"), "out"), sums.count())
        out = RoundTables(edges.sparkSession, "normalized").write(triplets.select("src", "dst", (F.col("weight") / F.col("out")).alias("weight")))
    finally:
        table.close()
    return out


def rank_program(edges: DataFrame, seed: str | int, d: float = 0.85, max_iter: int = 15, weighted: bool = True) -> DataFrame:
    """(id, rank) of every vertex, as a vertex program; vertices that the seed doesn't reach have 0.

    The unweighted form divides by the out-degree, which is a second state column. All triplets send in every round: a vertex
    with an edge into it gets a message each time, so no edge would ever rest.
    """
    at_seed = F.col("id") == F.lit(seed)
    start = graph_vertices(edges, rank=F.lit(0.0))
    message = F.lit(d) * F.col("s.rank") * F.col("weight")
    if not weighted:
        degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        start = start.join(degrees, "id", "left").select("id", "rank", F.coalesce("degree", F.lit(0)).alias("degree"))
        message = F.lit(d) * F.col("s.rank") / F.col("s.degree")
    update = {"rank": F.when(at_seed, F.lit(1.0 - d)).otherwise(F.lit(0.0)) + F.col("msg")}
    return pregel(start, edges, update, F.sum, to_dst=message, initial=F.lit(0.0), active="all", reads_target=False, max_iter=max_iter).select("id", "rank")


def path_program(edges: DataFrame, source: str | int) -> DataFrame:
    """(id, dist) of the vertices that ``source`` reaches: a vertex takes its shortest message only where it betters its distance.

    The target compares, after messages to it were merged on the way; the triplets are not shuffled to meet its state.
    """
    inf = F.lit(float("inf"))
    start = graph_vertices(edges, dist=F.when(F.col("id") == F.lit(source), F.lit(0.0)).otherwise(inf))
    through = F.col("s.dist") + F.col("weight")
    way = F.when(F.col("s.dist") < inf, through)
    out = pregel(start, edges, {"dist": F.least("dist", "msg")}, F.min, to_dst=way, initial=inf, active="out", reads_target=False, accepts=F.col("msg") < F.col("dist"))
    return out.filter(F.col("dist") < inf)
