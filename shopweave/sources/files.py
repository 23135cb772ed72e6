"""Readers and writers for the shopping data's file layouts.

Text inputs are read with an explicit schema (no inference). The legacy text
layouts of intermediate results (pair counts as ``((u,s),c)``, space-separated
feature rows and edge lists, ``user,city city …`` lists) can be imported and
exported; intermediate results are otherwise written as parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopweave.schemas import EDGE, FEATURES_CLS, FEATURES_REG, ID_EDGE, LOG, SHOP

# Fixed text formats of the input files.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
PAIR_COUNT_PATTERN = r"^\(\((-?\d+),(-?\d+)\),(-?\d+)\)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Purchase or view log: ``user_id,shop_id,yyyy-MM-dd HH:mm:ss`` per line."""
    return (
        spark.read.schema(LOG)
        .option("timestampNTZFormat", TIME_FORMAT)
        .option("mode", "FAILFAST")
        .csv(path)
    )


LOG_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def read_log_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A log that may have malformed lines: the good rows (user_id, shop_id, ts), and (line, file, reason) of the rest.

    Reasons: ``fields`` (not three of them), ``user`` or ``shop`` (no long), ``time`` (not in the layout, or no
    such instant). Every line is in exactly one of both frames; ``read_log`` fails on the first bad line instead.
    """
    parts = F.split("value", ",", -1)
    when = F.get(parts, F.lit(2))
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.size(parts).alias("n"),
        F.get(parts, F.lit(0)).try_cast("long").alias("user_id"), F.get(parts, F.lit(1)).try_cast("long").alias("shop_id"),
        F.when(when.rlike(LOG_TIME_PATTERN), when.try_cast("timestamp_ntz")).alias("ts"),
    )
    reason = F.when(F.col("n") != 3, "fields").when(F.col("user_id").isNull(), "user").when(F.col("shop_id").isNull(), "shop").when(F.col("ts").isNull(), "time")
    marked = lines.withColumn("reason", reason)
    return marked.filter("reason is null").select("user_id", "shop_id", "ts"), marked.filter("reason is not null").select("line", "file", "reason")


def quarantine(bad: DataFrame, path: str) -> DataFrame:
    """Malformed lines written beside the data, by reason, and read again."""
    bad.write.mode("overwrite").partitionBy("reason").parquet(path)
    return bad.sparkSession.read.schema(bad.schema).parquet(path)


def write_log_text(log: DataFrame, path: str) -> None:
    """A log in the layout that ``read_log`` reads."""
    log.select("user_id", "shop_id", F.date_format("ts", TIME_FORMAT).alias("ts")).write.mode("overwrite").csv(path)


def write_shop_text(shop: DataFrame, path: str) -> None:
    """The shop table in the layout that ``read_shop`` reads; nulls and missing columns become blank fields."""
    have = set(shop.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast("string").alias(f.name) for f in SHOP.fields]
    shop.select(*cols).write.mode("overwrite").option("emptyValue", "").csv(path)


def read_shop(spark: SparkSession, path: str) -> DataFrame:
    """Shop table: blank score / comment count fields read as null."""
    return spark.read.schema(SHOP).option("mode", "FAILFAST").csv(path)


def read_pair_counts_text(spark: SparkSession, path: str) -> DataFrame:
    """Pair counts in the ``((user,shop),count)`` text layout → (user_id, shop_id, count)."""
    line = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(line, PAIR_COUNT_PATTERN, 1).cast("long").alias("user_id"),
        F.regexp_extract(line, PAIR_COUNT_PATTERN, 2).cast("long").alias("shop_id"),
        F.regexp_extract(line, PAIR_COUNT_PATTERN, 3).cast("long").alias("count"),
    )


def write_pair_counts_text(df: DataFrame, path: str) -> None:
    text = F.format_string("((%d,%d),%d)", "user_id", "shop_id", "count")
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, task: str = "classification") -> DataFrame:
    """Space-separated feature rows (named columns, shop_id second)."""
    schema = FEATURES_CLS if task == "classification" else FEATURES_REG
    return spark.read.schema(schema).option("sep", " ").option("mode", "FAILFAST").csv(path)


def write_features_text(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_edges(spark: SparkSession, path: str, numeric: bool = False) -> DataFrame:
    """Edge list ``src dst weight`` per line."""
    return spark.read.schema(ID_EDGE if numeric else EDGE).option("sep", " ").option("mode", "FAILFAST").csv(path)


def write_edges_text(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "weight").write.mode("overwrite").option("sep", " ").csv(path)


def read_edge_lists(spark: SparkSession, paths: list[str], numeric: bool = False, merge: bool = False) -> DataFrame:
    """Several edge lists as one bag (``merge`` sums parallel edges)."""
    from shopweave.operators.graph import union_edges

    return union_edges(*[read_edges(spark, p, numeric) for p in paths], merge=merge)


def read_user_cities(spark: SparkSession, path: str) -> DataFrame:
    """``user_id,city city …`` lines → (user_id, sorted distinct cities)."""
    parts = F.split(F.col("value"), ",", 2)
    cities = F.array_sort(F.array_distinct(F.split(F.trim(parts[1]), " +")))
    return spark.read.text(path).select(parts[0].cast("long").alias("user_id"), cities.alias("cities"))


def write_user_cities_text(df: DataFrame, path: str) -> None:
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.array_join("cities", " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def cities_of(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """One user's city set, exploded: (city). Empty for an unknown user."""
    return read_user_cities(spark, path).filter(F.col("user_id") == user_id).select(F.explode("cities").alias("city"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Session temp view (queried by plain name)."""
    df.createOrReplaceTempView(name)
    return df
