"""Rounds of messages along edges, the common form of the rank loops (``pregel`` has the general one).

A loop is given by two Column expressions: the message that a vertex sends
along an edge (over ``value`` and the edge's ``w``) and how messages to one vertex merge. State may be
keyed further (one row per source and vertex). Only vertices that have a value are stored.

Edges are spread by (src, salt) once, in a bucketed table: a source with very many edges has as many salts
as its degree asks for. A round shuffles the active vertices to them (a heavy vertex once
per salt), while the edges stay where they are; it merges messages with partial aggregation and writes the new state.
Everything a round reads is a written table, so a lost executor costs the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.operators.skew import ROWS_PER_SALT, fanned, heavy_keys, salted, skew_join
from shopweave.session import BucketedTable, RoundTables, discard, stored, tasks_for


#: Rows of senders per task up to which a round hashes them; beyond, it sorts both sides of its join.
HASH_ROWS = 1_000_000


class EdgeTable:
    """Edges (src, dst, attributes…) bucketed by (src, salt) for a loop's rounds. ``is_stored``: they needn't be stored for that."""

    def __init__(self, edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT, is_stored: bool = False):
        self.base = edges if is_stored else stored(edges, "edges")
        self.tasks = tasks_for(self.base)
        heavy = heavy_keys(self.base, "src", rows_per_salt)
        self.heavy = edges.sparkSession.createDataFrame(heavy.collect(), heavy.schema)  # at most MAX_HEAVY_KEYS rows
        self.table = BucketedTable(edges.sparkSession, "edges", ["src", "_salt"], self.tasks)
        self.table.append(salted(self.base, self.heavy, "src", ["dst"]).repartition(self.tasks, "src", "_salt"))
        self.edges = self.table.read()

    def triplets(self, senders: DataFrame, rows: int | None = None) -> DataFrame:
        """The edges of the senders (src, …), with the senders' columns.

        ``rows``: how many senders there are at most. If they are few enough for each task to hash its share, the edges
        stream past them; otherwise both sides are sorted, the edges in every round anew.
        """
        fan = fanned(senders, self.heavy, "src")
        if rows is not None and rows <= HASH_ROWS * self.tasks:
            fan = fan.hint("shuffle_hash")
        return fan.join(self.edges, ["src", "_salt"]).drop("_salt")

    def send(self, active: DataFrame, keys: list[str], message: Column, rows: int | None = None) -> DataFrame:
        """(*keys, id, value): the messages of the active vertices (*keys, id, value), over ``value`` and the edge's ``w``."""
        return self.triplets(active.withColumnRenamed("id", "src"), rows).select(*keys, F.col("dst").alias("id"), message.alias("value"))

    def forget_base(self) -> None:
        """Deletes ``base``: rounds read the bucketed edges alone."""
        discard(self.base)

    def has(self, vertex) -> bool:
        v = F.lit(vertex)
        return not self.base.filter((F.col("src") == v) | (F.col("dst") == v)).isEmpty()

    def close(self) -> None:
        self.table.close()


class PlacedEdges:
    """Edges (src, dst, attributes…) without parallels for a loop's rounds, each placed by the end that has fewer of them.

    An edge from a hub lies where the other edges into its target lie. So a hub's row is sent once per place of its edges instead
    of once per edge, and messages to one target are merged before they are shuffled. Of E edges, a vertex places
    2·sqrt(E) at most, so no place is skewed and nothing is salted. There is a place per bucket of the table; run the rounds
    under ``session.partial_keys``, so that the edges stay there though the join is on (src, place). ``spent``: stored tables
    that nothing reads once ``edges`` are stored here; they are deleted.
    """

    def __init__(self, edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT, spent: Sequence[DataFrame] = ()):
        spark = edges.sparkSession
        self.base = stored(edges, "edges")
        for table in spent:
            discard(table)
        self.tasks = tasks_for(self.base)
        out = self.base.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
        into = self.base.groupBy("dst").agg(F.count(F.lit(1)).alias("_into"))
        heavy = heavy_keys(self.base, "dst", rows_per_salt)
        e = skew_join(skew_join(self.base, out, "src", rows_per_salt=rows_per_salt), into, "dst", "left", heavy=heavy)
        end = F.when(F.col("_out") > F.coalesce("_into", F.lit(0)), F.xxhash64("dst")).otherwise(F.xxhash64("src"))
        names = spark.range(64 * self.tasks).groupBy(F.pmod(F.hash("id"), F.lit(self.tasks)).alias("bucket")).agg(F.min("id").alias("name"))
        names = sorted(r.name for r in names.collect())  # a number per bucket that it is the hash of
        placed = e.withColumn("_place", F.array(*map(F.lit, names))[F.pmod(end, F.lit(len(names))).cast("int")].cast("long")).drop("_out", "_into")
        self.table = BucketedTable(spark, "edges", ["_place"], self.tasks)
        self.table.append(placed.repartition(self.tasks, "_place"))
        self.edges = self.table.read()
        self.places = stored(self.edges.select("src", "_place").distinct(), "places")

    def triplets(self, senders: DataFrame, rows: int | None = None) -> DataFrame:
        """The edges of the senders (src, …), with the senders' columns. ``rows``: how many senders there are at most (see ``EdgeTable``)."""
        spread = senders.join(self.places, "src").repartition(self.tasks, "_place")
        if rows is not None and rows <= HASH_ROWS:  # a sender is in all places at most
            spread = spread.hint("shuffle_hash")
        return spread.join(self.edges, ["src", "_place"]).drop("_place")

    def forget_base(self) -> None:
        """Deletes ``base``: rounds read the placed edges alone."""
        discard(self.base)

    def close(self) -> None:
        self.table.close()


def message_rounds(
    table: EdgeTable,
    start: DataFrame,
    message: Column,
    merge: Callable[[str], Column],
    inject: DataFrame,
    rounds: int,
    stop: Callable[[DataFrame, DataFrame], bool] | None = None,
) -> DataFrame:
    """(*keys, id, value) after the rounds; ``start`` has the same columns.

    The merged messages and the rows of ``inject`` are the new state, and all of it
    sends. ``stop(old, new)`` may end the loop earlier.
    """
    keys = [c for c in start.columns if c not in ("id", "value")]
    tables = RoundTables(start.sparkSession, "rounds")
    try:
        state = tables.write(start)
        for _ in range(rounds):
            pool = table.send(state, keys, message, state.count()).unionByName(inject.select(*keys, "id", "value"))
            old, state = state, tables.write(pool.groupBy(*keys, "id").agg(merge("value").alias("value")))
            if stop is not None and stop(old, state):
                break
    finally:
        tables.close()
    return state.select(*keys, "id", "value")
