"""Explicit schemas of the shopping data model (no inference anywhere)."""

from pyspark.sql import types as T

# Purchase and page-view logs: one row per event; (user, shop) may repeat.
LOG = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("shop_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
    ]
)

# Shop attributes; score / comment_cnt may be blank in text input.
SHOP = T.StructType(
    [
        T.StructField("shop_id", T.LongType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("location_id", T.IntegerType(), False),
        T.StructField("per_pay", T.IntegerType(), False),
        T.StructField("score", T.IntegerType(), True),
        T.StructField("comment_cnt", T.IntegerType(), True),
        T.StructField("shop_level", T.IntegerType(), False),
        T.StructField("cate1", T.StringType(), True),
        T.StructField("cate2", T.StringType(), True),
        T.StructField("cate3", T.StringType(), True),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
    ]
)

# Numeric-id edges (user-user similarity, clustering input).
ID_EDGE = T.StructType(
    [
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
        T.StructField("weight", T.DoubleType(), False),
    ]
)

_FEATURE_HEAD = ["user_id", "shop_id", "num_pay", "num_view"]
_FEATURE_SHOP = ["location_id", "per_pay", "score", "comment_cnt", "shop_level"]

FEATURES_CLS = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in _FEATURE_HEAD]
    + [T.StructField(c, T.IntegerType(), False) for c in _FEATURE_SHOP]
    + [T.StructField("bought_after", T.IntegerType(), False)]
)

FEATURES_REG = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in _FEATURE_HEAD]
    + [T.StructField(c, T.IntegerType(), False) for c in _FEATURE_SHOP]
    + [T.StructField("after_buy_count", T.LongType(), False)]
)

# The eight model inputs; user_id is fed as a number, as in the source job.
FEATURE_COLUMNS = ["user_id", "num_pay", "num_view", "location_id", "per_pay", "score", "comment_cnt", "shop_level"]
