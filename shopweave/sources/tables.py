"""Canonical ``pay`` / ``view`` / ``shop`` tables derived from the test tables.

The shopping data model has three inputs: a purchase log, a page-view log and
a shop table. On the driver's TPC-H-like tables they map as follows
(all joins are equi-joins the optimizer plans; only needed columns are read):

- pay:  orders ⋈ lineitem → (o_custkey, l_suppkey, o_orderdate)
- shop: supplier ⋈ nation → attributes derived from the supplier row
- view: events of type view/click, shop from ``props.k`` modulo the number of
  suppliers, time re-derived from ``event_id`` so it overlaps the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (they must match the oracle SQL).
VIEW_EPOCH = "1995-01-01"  # first day of the re-derived view times
VIEW_DAY_SPAN = 2405  # view day = event_id mod this many days
VIEW_EVENT_TYPES = ("view", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events (user_id, shop_id, ts): one row per line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("o_orderdate").alias("ts"),
    )


def view_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-view events (user_id, shop_id, ts)."""
    n_shops = table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    day = F.date_add(F.lit(VIEW_EPOCH).cast("date"), (F.col("event_id") % VIEW_DAY_SPAN).cast("int"))
    return events.filter(F.col("event_type").isin(*VIEW_EVENT_TYPES)).select(
        "user_id",
        (F.get_json_object("props", "$.k").cast("bigint") % n_shops).alias("shop_id"),
        day.cast("timestamp_ntz").alias("ts"),
    )


def shop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop attributes (shop_id, city, location_id, per_pay, score, comment_cnt, shop_level).

    score and comment_cnt are null for some shops, as blank fields are in the
    text form of the data; the feature table fills them with -1.
    """
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    return sup.join(nation, sup.s_nationkey == nation.n_nationkey).select(
        k.alias("shop_id"),
        F.col("n_name").alias("city"),
        F.col("s_nationkey").cast("int").alias("location_id"),
        F.floor(F.abs(F.col("s_acctbal")) / 100).cast("int").alias("per_pay"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 5).cast("int").alias("score"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(k % 50).cast("int").alias("comment_cnt"),
        (k % 3).cast("int").alias("shop_level"),
    )


# SQL of the same three tables, for oracle queries (DuckDB dialect).
PAY_SQL = """select o_custkey as user_id, l_suppkey as shop_id, o_orderdate as ts
from orders join lineitem on o_orderkey = l_orderkey"""

VIEW_SQL = """select user_id,
  cast(json_extract_string(props, '$.k') as bigint) % (select count(*) from supplier) as shop_id,
  cast(date '1995-01-01' + cast(event_id % 2405 as integer) as timestamp) as ts
from events where event_type in ('view', 'click')"""

SHOP_SQL = """select s_suppkey as shop_id, n_name as city, cast(s_nationkey as integer) as location_id,
  cast(floor(abs(s_acctbal) / 100) as integer) as per_pay,
  cast(case when s_suppkey % 5 = 0 then null else s_suppkey % 5 end as integer) as score,
  cast(case when s_suppkey % 7 = 0 then null else s_suppkey % 50 end as integer) as comment_cnt,
  cast(s_suppkey % 3 as integer) as shop_level
from supplier join nation on s_nationkey = n_nationkey"""


def base_ctes() -> str:
    """``with`` prefix defining pay_log / view_log / shop_info for oracle SQL."""
    return f"with pay_log as ({PAY_SQL}),\nview_log as ({VIEW_SQL}),\nshop_info as ({SHOP_SQL})"
