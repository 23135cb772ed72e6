"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

Library code never invents a checkpoint location on a cluster: it reads
``spark.checkpoint.dir`` from the session. Only local sessions (tests, bench,
the driver's smoke run) may fall back to a fresh folder under /tmp.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "shopweave", memory: str = "16g") -> SparkSession:
    """Session for tests and the benchmark: AQE on, UI off, UTC clock."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    Order: the SparkContext's folder, then ``spark.checkpoint.dir``. A folder of
    our own is made only for a local master (tests); on a cluster an unset
    folder is an error, since a machine-local path does not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shopweave-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3) "
        "so iterative operators can cut lineage reliably"
    )


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: for tables that are read many times."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a ``stored`` table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes that a task of a fixed number of tasks should read.
TASK_BYTES = 128 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks to deal a stored table to: by its size as Spark measures it, and no fewer than ``spark.sql.shuffle.partitions``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # what Spark takes for unknown
        raise ValueError("store the table first: Spark doesn't know its size")
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


@contextmanager
def partial_keys(spark: SparkSession) -> Iterator[None]:
    """Joins run meanwhile leave a side where it lies if both sides are dealt by the same ones of the join's columns.

    By default Spark deals both anew by all the columns, as a few values of one may be skewed.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BucketedTable:
    """A table in the shared checkpoint folder, bucketed by some columns.

    Joins and aggregations on these columns read it without a shuffle. Rows are appended in
    lots, on request as partitions by another column. ``close`` deletes it.
    """

    def __init__(self, spark: SparkSession, name: str, by: list[str], buckets: int, partition: str | None = None):
        self.spark, self.by, self.buckets, self.partition = spark, by, buckets, partition
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.name}"

    def append(self, df: DataFrame) -> None:
        writer = df.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, *self.by)
        with swept(self.spark):
            (writer.partitionBy(self.partition) if self.partition else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        delete(self.spark, self.path)


class RoundTables:
    """The tables of a loop's rounds, written to the shared checkpoint folder.

    A written table cuts lineage, so plans stay one round deep and a lost executor
    costs at most one round. The table before the last is deleted with each round;
    ``close`` deletes all but the last one, which the caller still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._held: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/round-{len(self._held)}"
        with swept(self.spark):
            df.write.parquet(path)
        self._held.append(path)
        if len(self._held) > 2:
            self._delete(self._held[-3])
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self._held[:-1][-2:]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)
