"""Feature table gaps, split boundary, time weights, label stats and file layouts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shopweave.functions.core import time_weight
from shopweave.operators import features as FE
from shopweave.operators import graph as G
from shopweave.sources import files as IO

LOG = "user_id long, shop_id long, ts timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


def shop_df(spark):
    return spark.createDataFrame(
        [(1, "A", 10, 3, 4, None, 1), (2, "B", 20, 5, None, 7, 2)],
        "shop_id long, city string, location_id int, per_pay int, score int, comment_cnt int, shop_level int",
    )


def test_split_boundary_hours_and_minutes(spark):
    pay = spark.createDataFrame(
        [(1, 1, ts("2016-06-30 12:24:00")), (1, 1, ts("2016-06-29 10:48:00")), (1, 1, ts("2016-07-01 00:00:00"))], LOG
    )
    assert FE.before(pay, "2016-07-01").count() == 2
    assert FE.from_split(pay, "2016-07-01").count() == 1


def test_feature_gaps(spark):
    split = "2016-07-01"
    pay = spark.createDataFrame(
        [
            (1, 1, ts("2016-01-01 00:00:00")),  # pay only, before
            (2, 1, ts("2016-08-01 00:00:00")),  # only after the split → label only
            (2, 1, ts("2016-08-02 00:00:00")),
            (4, 9, ts("2016-01-01 00:00:00")),  # shop not in the shop table
        ],
        LOG,
    )
    view = spark.createDataFrame(
        [(3, 2, ts("2016-02-01 00:00:00")), (5, 2, ts("2016-09-01 00:00:00"))], LOG  # view only; late view ignored
    )
    cls = {(r["user_id"], r["shop_id"]): r for r in FE.pair_features(pay, view, shop_df(spark), split).collect()}
    assert set(cls) == {(1, 1), (2, 1), (3, 2)}
    assert (cls[(1, 1)]["num_pay"], cls[(1, 1)]["num_view"], cls[(1, 1)]["bought_after"]) == (1, 0, 0)
    assert (cls[(2, 1)]["num_pay"], cls[(2, 1)]["bought_after"]) == (0, 1)
    assert (cls[(3, 2)]["num_view"], cls[(3, 2)]["score"], cls[(3, 2)]["comment_cnt"]) == (1, -1, 7)
    assert cls[(1, 1)]["comment_cnt"] == -1
    reg = {(r["user_id"], r["shop_id"]): r for r in FE.pair_features(pay, view, shop_df(spark), split, "regression").collect()}
    assert reg[(2, 1)]["after_buy_count"] == 2
    kept = FE.pair_features(pay, view, shop_df(spark), split, missing_shop="keep").collect()
    assert {(r["user_id"], r["shop_id"]) for r in kept} == {(1, 1), (2, 1), (3, 2), (4, 9)}
    assert [r["location_id"] for r in kept if r["shop_id"] == 9] == [-1]


def test_feature_key_unique(spark):
    from shopweave.plans.registry import q_pair_features_cls

    f = q_pair_features_cls(spark, "/root/testdata/sf0.001")
    assert f.count() == f.select("user_id", "shop_id").distinct().count()


def test_time_weights(spark):
    df = spark.createDataFrame([(ts("1970-01-01 00:00:25"),)], "ts timestamp_ntz")
    r = df.select(
        time_weight("ts", "1970-01-01 00:00:00", "1970-01-01 00:01:40", "recent").alias("recent"),
        time_weight("ts", "1970-01-01 00:00:00", "1970-01-01 00:01:40", "age").alias("age"),
    ).first()
    assert r["recent"] == pytest.approx(0.25)
    assert r["age"] == pytest.approx(1.75)
    pay = spark.createDataFrame([(1, 1, ts("1970-01-01 00:00:25"))], LOG)
    ev = G.weighted_events(pay, pay, "1970-01-01 00:00:00", "1970-01-01 00:01:40").collect()
    assert sorted(r["weight"] for r in ev) == [pytest.approx(0.125), pytest.approx(0.25)]


def test_time_weight_independent_of_session_zone(spark):
    df = spark.createDataFrame([(ts("2001-04-01 02:30:00"),)], "ts timestamp_ntz")
    expr = time_weight("ts", "1995-01-01", "2001-08-02").alias("w")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = df.select(expr).first()["w"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ny == df.select(expr).first()["w"]


def test_zero_weight_edges_dropped(spark):
    pay = spark.createDataFrame([(1, 1, ts("1995-01-01 00:00:00")), (1, 2, ts("2000-01-01 00:00:00"))], LOG)
    e = G.user_shop_edges(G.weighted_events(pay, None, "1995-01-01", "2001-08-02"))
    assert sorted(r["dst"] for r in e.collect() if r["src"] == "u1") == ["s2"]


def test_label_stats_population(spark):
    df = spark.createDataFrame([(0,), (2,), (4,)], "after_buy_count long")
    r = FE.label_stats(df).first()
    assert (r["label_min"], r["label_max"], r["n"]) == (0, 4, 3)
    assert r["label_mean"] == pytest.approx(2.0)
    assert r["label_var"] == pytest.approx(8 / 3)


def test_text_layouts_round_trip(spark, scratch):
    p = os.path.join(scratch, "pay.csv")
    with open(p, "w") as fh:
        fh.write("1,2,2016-06-30 12:24:00\n3,4,2016-07-02 01:02:03\n")
    log = IO.read_log(spark, p)
    assert [r["ts"] for r in log.orderBy("user_id").collect()] == [ts("2016-06-30 12:24:00"), ts("2016-07-02 01:02:03")]

    sp = os.path.join(scratch, "shop.csv")
    with open(sp, "w") as fh:
        fh.write("23,CITY_A,645,3,3,0,1,c1,c2,\n24,CITY_B,7,2,,,0,,,\n")
    shop = {r["shop_id"]: r for r in IO.read_shop(spark, sp).collect()}
    assert shop[24]["score"] is None and shop[23]["comment_cnt"] == 0

    counts = spark.createDataFrame([(1, 2, 3), (10, 20, 30)], "user_id long, shop_id long, count long")
    IO.write_pair_counts_text(counts, os.path.join(scratch, "counts"))
    assert sorted(tuple(r) for r in IO.read_pair_counts_text(spark, os.path.join(scratch, "counts")).collect()) == [
        (1, 2, 3), (10, 20, 30)]

    e = spark.createDataFrame([("u1", "s2", 0.5)], "src string, dst string, weight double")
    IO.write_edges_text(e, os.path.join(scratch, "edges"))
    IO.write_edges_text(e, os.path.join(scratch, "edges2"))
    both = IO.read_edge_lists(spark, [os.path.join(scratch, "edges"), os.path.join(scratch, "edges2")], merge=True)
    assert [tuple(r) for r in both.collect()] == [("u1", "s2", 1.0)]

    uc = os.path.join(scratch, "cities.txt")
    with open(uc, "w") as fh:
        fh.write("7,B A B\n8,C\n")
    assert [r["city"] for r in IO.cities_of(spark, uc, 7).collect()] == ["A", "B"]
    assert IO.cities_of(spark, uc, 99).count() == 0

    feats = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 8, 9, 1)], "a long, b long, c long, d long, e int, f int, g int, h int, i int, j int")
    IO.write_features_text(feats, os.path.join(scratch, "feat"))
    back = IO.read_features(spark, os.path.join(scratch, "feat"))
    assert back.first()["bought_after"] == 1 and back.first()["shop_id"] == 2


def test_events_before_start(spark):
    pay = spark.createDataFrame([(1, 1, ts("1994-01-01 00:00:00")), (1, 2, ts("2000-01-01 00:00:00"))], LOG)
    dropped = G.user_shop_edges(G.weighted_events(pay, None, "1995-01-01", "2001-08-02"), False)
    assert [r["dst"] for r in dropped.collect()] == ["s2"]
    with pytest.raises(Exception, match="before 1995-01-01"):
        G.weighted_events(pay, None, "1995-01-01", "2001-08-02", before_start="error").collect()
    with pytest.raises(ValueError):
        time_weight("ts", "1995-01-01", "2001-08-02", before_start="keep")


def test_shop_and_log_layouts_round_trip(spark, scratch):
    shop = shop_df(spark)
    IO.write_shop_text(shop, os.path.join(scratch, "shop"))
    back = IO.read_shop(spark, os.path.join(scratch, "shop"))
    assert sorted(map(tuple, back.select(*shop.columns).collect())) == sorted(map(tuple, shop.collect()))
    log = spark.createDataFrame([(1, 2, ts("2016-06-30 12:24:00"))], LOG)
    IO.write_log_text(log, os.path.join(scratch, "log"))
    assert [tuple(r) for r in IO.read_log(spark, os.path.join(scratch, "log")).collect()] == [tuple(r) for r in log.collect()]


@pytest.mark.parametrize("parts", [0, 3])
def test_streaming_counts_equal_batch(spark, scratch, parts):
    from shopweave.sources.tables import pay_log
    from shopweave.streaming.counts import run_to_table, stream_pay_log, windowed_pair_counts

    sf = "/root/testdata/sf0.001"
    if parts:  # the same table as a folder of part files
        spark.read.parquet(f"{sf}/lineitem.parquet").repartition(parts).write.parquet(f"{scratch}/lineitem.parquet")
        spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{scratch}/orders.parquet")
        sf = scratch
    streamed = run_to_table(windowed_pair_counts(stream_pay_log(spark, sf)))
    batch = windowed_pair_counts(pay_log(spark, sf))
    assert sorted(tuple(r) for r in streamed.collect()) == sorted(tuple(r) for r in batch.collect())
    assert streamed.agg(F.sum("count")).first()[0] == pay_log(spark, sf).count()


def test_streaming_several_batches_and_no_input(spark, scratch):
    from shopweave.streaming.counts import run_to_table, windowed_pair_counts

    src = os.path.join(scratch, "in")
    for k in range(3):  # one file per batch; the pair (1, 1) grows in each
        spark.createDataFrame([(1, 1, ts("2000-01-01 00:00:00")), (k, 2, ts("2000-01-02 00:00:00"))], LOG).coalesce(1).write.mode("append").parquet(src)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r["user_id"], r["shop_id"]): r["count"] for r in run_to_table(windowed_pair_counts(log)).collect()}
    assert got == {(1, 1): 3, (0, 2): 1, (1, 2): 1, (2, 2): 1}
    spark.createDataFrame([], LOG).write.parquet(os.path.join(scratch, "none"))
    empty = run_to_table(windowed_pair_counts(spark.readStream.schema(LOG).parquet(os.path.join(scratch, "none"))))
    assert empty.count() == 0 and empty.columns == ["window_start", "user_id", "shop_id", "count"]
