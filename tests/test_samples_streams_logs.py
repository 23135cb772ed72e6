"""Samples with replacement, late rows of a stream, malformed log lines, sums of written edges."""

import random

import pytest
from pyspark.sql import functions as F

from shopweave.operators import clusters as C
from shopweave.sources import files as IO
from shopweave.streaming import counts as S
from tests.test_graph_fixtures import TOY, edges


@pytest.mark.parametrize("rate", [0.05, 1.0, 3.0])
def test_bootstrap_is_poisson_and_alike_on_every_layout(spark, rate):
    members = spark.range(20_000).select("id", F.lit(1).alias("cluster"))
    got = C.bootstrap_sample(members, rate, "x")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, C.bootstrap_sample(members.repartition(5), rate, "x").collect()))
    assert abs(len(rows) / 20_000 - rate) < 4 * (rate / 20_000) ** 0.5
    times = {}
    for i, _, copy in rows:
        assert copy == times.get(i, 0) + 1
        times[i] = copy
    twice = sum(n > 1 for n in times.values()) / 20_000
    steps = C.poisson_steps(rate)
    assert abs(twice - (1 - steps[1])) < 0.01 and C.bootstrap_sample(members, 0.0, "x").count() == 0


def test_malformed_lines_are_kept_apart(spark, scratch):
    good = ["1,2,2000-01-01 00:00:00", "-3,4,1999-12-31 23:59:59", "5,6,2000-02-29 12:00:00"]
    bad = {"": "fields", "1,2": "fields", "1,2,2000-01-01 00:00:00,": "fields", "x,2,2000-01-01 00:00:00": "user", "99999999999999999999,2,2000-01-01 00:00:00": "user",
           "1,,2000-01-01 00:00:00": "shop", "1,2.5,2000-01-01 00:00:00": "shop", "1,2,2000-01-01": "time", "1,2,2001-02-29 00:00:00": "time", "1,2,2000-01-01 25:00:00": "time", "1,2,": "time"}
    lines = good + list(bad)
    random.Random(1).shuffle(lines)
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{scratch}/log")
    rows, rest = IO.read_log_checked(spark, f"{scratch}/log")
    assert sorted(f"{r.user_id},{r.shop_id},{r.ts}" for r in rows.collect()) == sorted(good)
    kept = IO.quarantine(rest, f"{scratch}/bad").collect()
    assert {r.line: r.reason for r in kept} == bad and len(kept) == len(bad) and all(r.file.endswith(".txt") for r in kept)


def arriving(spark, path, batches):
    schema = "user_id long, shop_id long, t string"
    for rows in batches:
        df = spark.createDataFrame(rows, schema).select("user_id", "shop_id", F.col("t").cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    events = S.counted_arrivals(S.stream_log_files(spark, path, df.schema, 1))
    return S.windowed_pair_counts(events, "30 days", "1 day")


# Windows of 30 days from 1970-01-01: one begins on 1999-12-25, the next ones on 2000-01-24 and 2000-02-23.
BATCHES = [
    [(1, 1, "2000-01-05 00:00:00"), (1, 1, "2000-01-06 00:00:00")],
    [(1, 1, "2000-02-01 00:00:00"), (2, 1, "2000-01-20 00:00:00")],  # 01-20: its window is still open
    [(1, 1, "2000-03-01 00:00:00")],
    [(1, 1, "2000-01-07 00:00:00"), (3, 1, "2000-01-08 00:00:00"), (1, 1, "2000-02-25 00:00:00")],  # two rows behind the watermark
]


def test_late_rows_are_counted(spark, scratch):
    table, report = S.run_reported(arriving(spark, f"{scratch}/in", BATCHES))
    got = {(str(r.window_start), r.user_id, r.shop_id): r["count"] for r in table.collect()}
    assert got == {("1999-12-25", 1, 1): 2, ("1999-12-25", 2, 1): 1, ("2000-01-24", 1, 1): 1, ("2000-02-23", 1, 1): 2}
    assert report == {"batches": 4, "arrived": 8} and report["arrived"] - sum(got.values()) == 2


def test_closed_windows_are_appended_once(spark, scratch):
    table, report = S.run_closed(arriving(spark, f"{scratch}/in", BATCHES))
    got = sorted((str(r.window_start), r.user_id, r["count"]) for r in table.collect())
    assert got == [("1999-12-25", 1, 2), ("1999-12-25", 2, 1), ("2000-01-24", 1, 1)]  # the last window is open
    assert report["arrived"] == 8


def test_sums_of_written_edges(spark, scratch):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    got = C.write_labelled_edges(edges(spark, TOY), a, f"{scratch}/labelled").first()
    assert got == C.cut_weight(edges(spark, TOY), a).first() and spark.read.parquet(f"{scratch}/labelled").count() == len(TOY)
