"""(user, shop) counts, labels around a split instant, and the feature table.

All of these are one aggregation keyed on (user_id, shop_id): partial
aggregation before the shuffle collapses repeated events map-side, so a hot
user or shop does not funnel raw events into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["user_id", "shop_id"]


def _split_lit(split: str) -> Column:
    return F.lit(split).cast("timestamp_ntz")


def before(log: DataFrame, split: str) -> DataFrame:
    return log.filter(F.col("ts") < _split_lit(split))


def from_split(log: DataFrame, split: str) -> DataFrame:
    return log.filter(F.col("ts") >= _split_lit(split))


def pair_counts(log: DataFrame) -> DataFrame:
    """Events per (user, shop): (user_id, shop_id, count)."""
    return log.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("count"))


def bought_after_label(pay: DataFrame, split: str) -> DataFrame:
    """Distinct (user, shop) with a purchase at or after ``split``, label 1."""
    return from_split(pay, split).select(*PAIR).distinct().withColumn("label", F.lit(1))


def after_buy_count(pay: DataFrame, split: str) -> DataFrame:
    """Purchases per (user, shop) at or after ``split``: (user_id, shop_id, count)."""
    return pair_counts(from_split(pay, split))


def shop_attributes(shop: DataFrame) -> DataFrame:
    """Shop columns the models use, blanks filled with -1."""
    return shop.select(
        "shop_id",
        "location_id",
        "per_pay",
        F.coalesce(F.col("score"), F.lit(-1)).cast("int").alias("score"),
        F.coalesce(F.col("comment_cnt"), F.lit(-1)).cast("int").alias("comment_cnt"),
        "shop_level",
    )


def pair_features(
    pay: DataFrame,
    view: DataFrame,
    shop: DataFrame,
    split: str,
    task: str = "classification",
    missing_shop: str = "drop",
) -> DataFrame:
    """One row per (user, shop) seen in pay before/after the split or in views before it.

    Equivalent to full outer joins of pay counts, labels and view counts on
    (user, shop), written as one tagged union and one aggregation: a single
    shuffle on the pair key instead of three joins. Shop attributes are then
    joined; Spark broadcasts them by their measured size or shuffles.

    ``task``: "classification" → ``bought_after`` 0/1; "regression" →
    ``after_buy_count``. ``missing_shop``: "drop" (inner join) or "keep"
    (left join, attributes -1).
    """
    split_ts = _split_lit(split)
    is_before = F.col("ts") < split_ts
    tagged = pay.select(
        *PAIR,
        F.when(is_before, 1).otherwise(0).alias("p"),
        F.lit(0).alias("v"),
        F.when(is_before, 0).otherwise(1).alias("a"),
    ).unionByName(before(view, split).select(*PAIR, F.lit(0).alias("p"), F.lit(1).alias("v"), F.lit(0).alias("a")))
    counts = tagged.groupBy(*PAIR).agg(
        F.sum("p").cast("long").alias("num_pay"),
        F.sum("v").cast("long").alias("num_view"),
        F.sum("a").cast("long").alias("after"),
    )
    attrs = shop_attributes(shop)
    how = "inner" if missing_shop == "drop" else "left"
    joined = counts.join(attrs, "shop_id", how)
    shop_cols = [F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in
                 ["location_id", "per_pay", "score", "comment_cnt", "shop_level"]]
    if task == "classification":
        label = (F.col("after") > 0).cast("int").alias("bought_after")
    elif task == "regression":
        label = F.col("after").alias("after_buy_count")
    else:
        raise ValueError(f"unknown task {task!r}")
    return joined.select("user_id", "shop_id", "num_pay", "num_view", *shop_cols, label)


def label_stats(df: DataFrame, label: str = "after_buy_count") -> DataFrame:
    """min, max, mean, population variance and deviation of a label column."""
    x = F.col(label).cast("double")
    return df.agg(
        F.min(label).cast("long").alias("label_min"),
        F.max(label).cast("long").alias("label_max"),
        F.avg(x).alias("label_mean"),
        F.var_pop(x).alias("label_var"),
        F.stddev_pop(x).alias("label_std"),
        F.count(F.lit(1)).alias("n"),
    )
