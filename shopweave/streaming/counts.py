"""Streaming form of the pair counts: running (user, shop) event counts per tumbling window.

The event time is a wall-clock TIMESTAMP_NTZ in the data; watermarks need a
TIMESTAMP, so it is turned into the instant with the same epoch seconds
(time-zone independent). Output uses ``update`` mode: a batch writes the keys whose
count changed to a folder of its own, and the last row of a key is its count.
``append`` would hold back windows the watermark has not closed yet, ``complete``
would write every key in every batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopweave.functions.core import epoch_seconds
from shopweave.session import ensure_checkpoint_dir


def event_time(ts: str = "ts"):
    return F.timestamp_seconds(epoch_seconds(ts))


def windowed_pair_counts(events: DataFrame, window: str = "30 days", watermark: str = "1 day") -> DataFrame:
    """(window_start date, user_id, shop_id, count) over a (streaming) log."""
    e = events.select("user_id", "shop_id", event_time("ts").alias("event_ts"))
    agg = e.withWatermark("event_ts", watermark).groupBy(F.window("event_ts", window), "user_id", "shop_id").count()
    start_day = (F.unix_seconds(F.col("window.start")) / 86400).cast("int")
    return agg.select(F.date_from_unix_date(start_day).alias("window_start"), "user_id", "shop_id", "count")


def stream_pay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as a stream: line-item files stream in, orders are a static table.

    The table may be one file or a folder of part files.
    """
    path = f"{sf_dir}/lineitem.parque[t]"  # a pattern: a stream takes a single file only by one
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").schema
    items = spark.readStream.schema(schema).parquet(path)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("shop_id"), F.col("o_orderdate").alias("ts")
    )


def stream_log_files(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """A log (user_id, shop_id, ts) whose files arrive as a stream, so many in a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Name of the metrics that ``counted_arrivals`` puts on a stream.
ARRIVED = "arrived"


def counted_arrivals(events: DataFrame) -> DataFrame:
    """The stream with the number of rows of each micro-batch as an observed metric."""
    return events.observe(ARRIVED, F.count(F.lit(1)).alias("rows"))


def run_to_table(result: DataFrame, keys: list[str] | None = None, out_dir: str | None = None) -> DataFrame:
    """Run a streaming aggregate over all available input and return its final table.

    Each micro-batch writes its changed rows to ``epoch=<n>`` under the session's
    shared checkpoint folder, with the stream's own checkpoint beside it. A batch
    that fails and runs again replaces its own folder and nothing else, so no
    earlier result is lost. The final row of each key (by default all columns but
    ``count``) is the one of its last epoch. Without input the table is empty.
    """
    return run_reported(result, keys, out_dir)[0]


def run_reported(result: DataFrame, keys: list[str] | None = None, out_dir: str | None = None) -> tuple[DataFrame, dict]:
    """``run_to_table`` and a report of the run: ``batches`` with rows and, after ``counted_arrivals``, ``arrived`` rows.

    A row that comes after the watermark has closed its window changes no count. Such rows are not lost in silence: they are the
    arrived rows less the sum of the final counts.
    """
    spark = result.sparkSession
    base = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = f"{base}/result"
    schema = T.StructType([*result.schema.fields, T.StructField("epoch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("append").partitionBy("epoch").parquet(target)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    q = (
        result.writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    keys = keys or [c for c in result.columns if c != "count"]
    rest = [c for c in result.columns if c not in keys]
    last = F.max(F.struct("epoch", *rest)).alias("last")
    table = spark.read.schema(schema).parquet(target).groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}") for c in rest]).select(*result.columns)
    return table, arrivals(q)


def run_closed(result: DataFrame, out_dir: str | None = None) -> tuple[DataFrame, dict]:
    """Run in ``append`` mode: (the rows of windows that the watermark has closed, report); a row is written once, when its window closes."""
    spark = result.sparkSession
    base = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = result.writeStream.outputMode("append").format("parquet").option("path", f"{base}/closed").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/closed"), arrivals(q)


def arrivals(query) -> dict:
    """Rows and batches of a query that has ended, from its progress; fails if the session no longer holds all of it."""
    progress = {p.batchId: p for p in query.recentProgress}
    if progress and len(progress) != max(progress) - min(progress) + 1 or len(query.recentProgress) >= int(query_limit()):
        raise RuntimeError("raise spark.sql.streaming.numRecentProgressUpdates above the number of batches")
    rows = [p.observedMetrics[ARRIVED]["rows"] for p in progress.values() if ARRIVED in p.observedMetrics]
    return {"batches": sum(n > 0 for n in rows), "arrived": sum(rows)}


def query_limit() -> str:
    return SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates")
