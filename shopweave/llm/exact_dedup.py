"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting every blank (space,
\\t \\n \\v \\f \\r); their sha-256 is the key. Of equal texts the row with the
most code points in its original text stays, then the smallest ``doc_id``
(null last), then the first row as read (``drop_copies``: the row with the smallest hash
of all its columns, so a stage run again keeps the same one).

A Misra-Gries summary per partition (``counters`` entries each) finds the
digests that may be frequent. The ``counters`` with the highest estimates are
counted exactly and their winners found by an aggregation that combines on
the map side; that table has at most ``counters`` rows, so it is broadcast and
rows of frequent digests are settled where they lie. All other digests, each of
which has a bounded share of every partition, go through one shuffle.

Null and blank texts count as the empty text and form one group. Repeated rows
are copies like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import BLANK, Shared

COUNTERS = 1024


def normalised_sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", ""), 256)


def misra_gries(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(digest, estimate): at most ``counters`` rows, the digests with the highest lower bounds.

    Each partition keeps ``counters`` counts. When more are held, the largest
    count that has to go is subtracted from all (the mergeable form of the
    decrement), so a digest with more than 1/(counters+1) of a partition is kept.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for d in batch.column(0).value_counts().to_pylist():
                held[d["values"]] = held.get(d["values"], 0) + d["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "estimate"])

    found = digests.select(column).mapInArrow(summary, "digest string, estimate long")
    total = found.groupBy("digest").agg(F.sum("estimate").alias("estimate")).filter("estimate > 1")
    return total.orderBy(F.desc("estimate"), "digest").limit(counters)


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of ``docs``."""
    shared = Shared(docs.sparkSession, "exact")
    rows = shared.table(
        docs.select(
            "doc_id",
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"),
            normalised_sha(F.col("text")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "rows",
    )
    frequent = shared.table(misra_gries(rows, "text_sha256", counters), "frequent")
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low"), (-F.col("place")).alias("first")))
    winners = (
        rows.join(F.broadcast(frequent.select(F.col("digest").alias("text_sha256"))), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", "group_size", (-F.col("best.low")).alias("keep_id"), (-F.col("best.first")).alias("keep_place"))
    )
    winners = shared.table(winners, "winners")  # at most ``counters`` rows
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    settled = split.filter("group_size is not null").withColumn("kept", F.col("place") == F.col("keep_place"))
    group = Window.partitionBy("text_sha256")
    order = group.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"), "place")
    shuffled = (
        split.filter("group_size is null")
        .select("doc_id", "points", "place", "text_sha256")
        .withColumn("kept", F.row_number().over(order) == 1)
        .withColumn("keep_id", F.first("doc_id").over(order))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return settled.select(*out).unionByName(shuffled.select(*out))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Frequent digests: rows that don't equal the winner's length and ``doc_id`` go
    on the map side; repeated rows among the rest collapse in an aggregation.
    Other digests: one shuffle by digest, the first row of each stays.
    """
    shared = Shared(docs.sparkSession, "exact")
    digest, whole = "__sha", "__row"
    points = F.coalesce(F.length("text"), F.lit(0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), normalised_sha(F.col("text")).alias(digest), points.alias("__points"), F.col("doc_id").alias("__id"))
    keyed = keyed.withColumn("__tie", F.xxhash64(whole))
    small = shared.table(keyed.drop(whole, "__tie"), "digests")
    frequent = shared.table(misra_gries(small, digest, counters), "frequent")
    winners = (
        small.join(F.broadcast(frequent.select(F.col("digest").alias(digest))), digest, "left_semi")
        .groupBy(digest)
        .agg(F.max(F.struct("__points", F.col("__id").isNotNull().alias("known"), (-F.col("__id")).alias("low"))).alias("best"))
        .select(digest, F.col("best.__points").alias("__most"), (-F.col("best.low")).alias("__keep"))
    )
    winners = shared.table(winners, "winners")
    split = keyed.join(F.broadcast(winners), digest, "left")
    settled = (
        split.filter(F.col("__most").isNotNull() & (F.col("__points") == F.col("__most")) & F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy(digest)
        .agg(F.min_by(whole, "__tie").alias(whole))
    )
    order = Window.partitionBy(digest).orderBy(F.desc("__points"), F.asc_nulls_last("__id"), "__tie")
    shuffled = split.filter(F.col("__most").isNull()).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return settled.select(f"{whole}.*").unionByName(shuffled.select(f"{whole}.*"))
