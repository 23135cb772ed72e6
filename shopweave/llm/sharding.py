"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly: a seeded hash of each row's place deals
it to one of B buckets, so large groups of equal rows spread like any others. B
is chosen so that a bucket's bytes fit in memory. Pass two shuffles each bucket
by Fisher-Yates and writes it. A row's place in the whole order is its bucket's
start plus its place in the bucket; shard s of S takes the places from
ceil(s * N / S) on, so two shards' counts differ by one at most (law ``rows``),
and ``slot`` is the place within the shard.

The input must be read from a table (or a checkpoint): places are scan
positions, which a task that is run again finds unchanged. The counts that give
the starts and the rows that are written come from two scans; the written
shards are compared with the counts, and a difference raises an error.

A null text has no bytes and the checksum of the empty text; it stays null in
the shard. Repeated rows are rows like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import Shared

SHARDS = 24
BUCKET_BYTES = 64 << 20
SEED = 20


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, shard, slot), written as one folder per shard and read again."""
    spark = docs.sparkSession
    shared = Shared(spark, "shards")
    total, rows = docs.agg(F.sum(record_size(F.col("text"))), F.count(F.lit(1))).first()
    buckets = max(4 * shards, -(-(total or 0) // bucket_bytes))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(buckets)).cast("int")

    counts = docs.select(dealt.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    starts = shared.table(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")

    def shuffle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bucket = key[0].as_py()
        order = np.random.default_rng([seed, bucket]).permutation(table.num_rows)  # Fisher-Yates
        table = table.select(["bucket", "doc_id", "text"]).take(pa.array(order)).append_column("at", pa.array(np.arange(table.num_rows), pa.int64()))
        yield from table.to_batches(max_chunksize=2048)

    scattered = docs.select(dealt.alias("bucket"), F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = scattered.groupBy("bucket").applyInArrow(_sorted_by_place(shuffle), "bucket int, doc_id long, text string, at long")
    place = F.col("start") + F.col("at")
    shard = F.floor(place * shards / F.lit(max(1, rows))).cast("int")
    first = F.ceil(F.col("shard").cast("long") * F.lit(rows) / shards)
    placed = ordered.join(F.broadcast(starts.select("bucket", "start")), "bucket").select("doc_id", "text", shard.alias("shard"), place.alias("place"))
    path = f"{shared.base}/shards"
    placed.select("doc_id", "text", "shard", (F.col("place") - first).cast("long").alias("slot")).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    check = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    if sum(r["n"] for r in check) != rows or any(r["n"] != r["top"] + 1 or r["n"] != r["slots"] for r in check):
        raise RuntimeError("the two scans of the input differ; shard a written table")
    return written.select("doc_id", "text", "shard", "slot")


def _sorted_by_place(shuffle):
    """The bucket's rows in scan order first, so the shuffle doesn't depend on the order in which they came."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        yield from shuffle(key, table.take(pa.array(order)).to_batches())

    return run


def shard_digest(written: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of written shards."""
    return written.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
