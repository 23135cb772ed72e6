"""Hand-worked graphs: normalisation, rank rounds, sinks, shortest paths, cut weight, ties."""

import math

import pytest
from pyspark.sql import functions as F

from shopweave.operators import clusters as C
from shopweave.operators import graph as G
from shopweave.operators import rank as R
from shopweave.operators import similarity as S

TOY = [(1, 2, 0.7), (2, 1, 0.7), (3, 2, 0.2), (2, 3, 2.0), (3, 4, 0.8), (4, 3, 0.8), (1, 4, 0.2), (4, 1, 0.2)]


def edges(spark, rows, string_ids=False):
    schema = "src string, dst string, weight double" if string_ids else "src long, dst long, weight double"
    return spark.createDataFrame(rows, schema)


def as_map(df, key=("src", "dst"), val="weight"):
    return {tuple(r[k] for k in key): r[val] for r in df.collect()}


def test_toy_normalisation(spark):
    got = as_map(G.normalize_out_weights(edges(spark, TOY)))
    want = {(1, 2): 7 / 9, (1, 4): 2 / 9, (2, 1): 7 / 27, (2, 3): 20 / 27, (3, 2): 1 / 5, (3, 4): 4 / 5,
            (4, 3): 4 / 5, (4, 1): 1 / 5}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def test_normalised_out_weights_sum_to_one(spark):
    n = G.normalize_out_weights(edges(spark, TOY + [(1, 2, 0.3)]))  # parallel edge stays separate
    sums = n.groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert n.count() == 9


def test_rank_rounds_two_vertex_cycle(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "a", 1.0)], string_ids=True)
    want = {0: (0.15, None), 1: (0.15, 0.1275), 2: (0.258375, 0.1275)}
    for rounds, (a, b) in want.items():
        got = {r["id"]: r["rank"] for r in R.personal_rank(e, "a", 0.85, rounds).collect()}
        assert got["a"] == pytest.approx(a)
        assert got.get("b") == (pytest.approx(b) if b is not None else None)


def test_rank_sink(spark):
    e = edges(spark, [("a", "b", 1.0)], string_ids=True)
    for rounds in (1, 3, 15):
        got = {r["id"]: r["rank"] for r in R.personal_rank(e, "a", 0.85, rounds).collect()}
        assert got["a"] == pytest.approx(0.15)
        assert got["b"] == pytest.approx(0.1275)


def test_rank_total_without_sinks(spark):
    n = G.normalize_out_weights(edges(spark, TOY))
    e = n.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    total = R.personal_rank(e, "1", 0.85, 15).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1 - 0.85 ** 16, abs=1e-12)


def test_rank_unknown_seed_is_empty(spark):
    e = edges(spark, [("a", "b", 1.0)], string_ids=True)
    assert R.personal_rank(e, "zzz", 0.85, 3).count() == 0


def test_unweighted_rank_uses_out_degree(spark):
    e = edges(spark, [("u1", "s1", 5.0), ("u1", "s2", 1.0), ("s1", "u1", 1.0), ("s2", "u1", 1.0)], string_ids=True)
    got = {r["id"]: r["rank"] for r in R.personal_rank(e, "u1", 0.85, 1, weighted=False).collect()}
    assert got["s1"] == pytest.approx(0.85 * 0.15 / 2)
    assert got["s2"] == pytest.approx(0.85 * 0.15 / 2)


def test_top_shops_tie_break_and_exclusion(spark):
    ranks = spark.createDataFrame(
        [("s2", "shop", 0.5), ("s1", "shop", 0.5), ("s3", "shop", 0.2), ("u1", "user", 0.9)], "id string, kind string, rank double"
    )
    assert [r["id"] for r in R.top_shops(ranks, 2).collect()] == ["s1", "s2"]
    ex = spark.createDataFrame([("s1",)], "id string")
    assert [r["id"] for r in R.top_shops(ranks, 2, exclude=ex).collect()] == ["s2", "s3"]


def test_many_seeds_equal_single_runs(spark):
    n = G.normalize_out_weights(edges(spark, TOY))
    e = n.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    seeds = spark.createDataFrame([("1",), ("3",)], "seed string")
    many = {(r["seed"], r["id"]): r["rank"] for r in R.personal_rank_many(e, seeds, 0.85, 6).collect()}
    for s in ("1", "3"):
        single = {r["id"]: r["rank"] for r in R.personal_rank(e, s, 0.85, 6).collect()}
        for v, x in single.items():
            assert many[(s, v)] == pytest.approx(x, abs=1e-12)


def test_shortest_paths_with_unreachable(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 1, 1.0)])
    src = spark.createDataFrame([(1,)], "source long")
    got = {r["id"]: r["dist"] for r in C.shortest_paths(e, src).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0}  # 4 is unreachable: absent (infinite)


@pytest.mark.parametrize("rows_per_salt", [1, 1_000_000])
def test_shortest_paths_with_and_without_salts(spark, rows_per_salt):
    e = edges(spark, TOY + [(1, k, 50.0) for k in range(5, 40)] + [(1, 2, 3.0)])
    src = spark.createDataFrame([(1,), (3,)], "source long")
    got = as_map(C.shortest_paths(e, src, rows_per_salt=rows_per_salt), ("source", "id"), "dist")
    assert got[(1, 3)] == pytest.approx(1.0)  # 1→4→3 = 0.2 + 0.8
    assert got[(3, 39)] == pytest.approx(0.2 + 0.7 + 50)  # 3→2→1→39
    assert len(got) == 2 * 39


def test_cut_weight_toy(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, cluster int")
    r = C.cut_weight(edges(spark, TOY), a).first()
    assert r["cut_weight"] == pytest.approx(2.6)
    assert r["cut_edges"] == 4
    assert r["cut_weight"] <= r["total_weight"]


def test_cut_weight_missing_labels_default_to_zero(spark):
    a = spark.createDataFrame([(3, 1), (4, 1)], "id long, cluster int")
    r = C.cut_weight(edges(spark, TOY), a).first()
    assert r["cut_weight"] == pytest.approx(2.6)


def test_hub_tie_goes_to_smaller_user(spark):
    us = edges(spark, [(9, 100, 0.5), (4, 100, 0.5), (9, 200, 0.5), (4, 200, 0.5)])
    hubs = {r["shop_id"]: r["hub"] for r in S.shop_hubs(us).collect()}
    assert hubs == {100: 4, 200: 4}


def test_hub_similarity_star_both_directions(spark):
    us = edges(spark, [(1, 100, 0.6), (2, 100, 0.3), (3, 100, 0.1)])
    sim = S.hub_similarity(us).collect()
    got = sorted((r["src"], r["dst"], round(r["weight"], 12)) for r in sim)
    assert got == [(1, 2, 0.18), (1, 3, 0.06), (2, 1, 0.18), (3, 1, 0.06)]  # no pair 2–3, no self pair


def test_silhouette_toy(spark):
    e = edges(spark, TOY)
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, cluster int")
    samples = spark.createDataFrame([(1,)], "id long")
    r = C.silhouette(e, a, samples).first()
    # distances from 1 over 1/w: 2 = 1/0.7; 3 = 2 + 1/2.0; 4 = min(1/0.2, 3 + 1/0.8)
    d2 = 1 / 0.7
    d3 = d2 + 0.5
    d4 = min(5.0, d3 + 1.25)
    a_ = (0 + d2) / 2
    b_ = (d3 + d4) / 2
    assert r["a"] == pytest.approx(a_)
    assert r["b"] == pytest.approx(b_)
    assert r["coefficient"] == pytest.approx((b_ - a_) / max(a_, b_))
    assert -1 <= r["coefficient"] <= 1


def test_silhouette_unreachable_cluster_is_infinite(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)])
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, cluster int")
    r = C.silhouette(e, a, spark.createDataFrame([(1,)], "id long")).first()
    assert math.isinf(r["b"]) and math.isnan(r["coefficient"])
    r2 = C.silhouette(e, a, spark.createDataFrame([(1,)], "id long"), unreachable="drop").first()
    assert r2["b"] is None and r2["a"] == pytest.approx(0.5)


def test_city_subgraph_keeps_users_and_allowed_shops(spark):
    e = edges(spark, [("u1", "s1", 1.0), ("s1", "u1", 1.0), ("u1", "s2", 1.0), ("s2", "u1", 1.0), ("u2", "s2", 1.0)],
              string_ids=True)
    allowed = spark.createDataFrame([("s1",)], "id string")
    got = sorted((r["src"], r["dst"]) for r in G.restrict_shops(e, allowed).collect())
    assert got == [("s1", "u1"), ("u1", "s1")]


def test_bidirectional_and_union(spark):
    e = edges(spark, [(1, 2, 1.0)])
    assert sorted((r["src"], r["dst"]) for r in G.bidirectional(e).collect()) == [(1, 2), (2, 1)]
    m = G.union_edges(e, e, merge=True).first()
    assert m["weight"] == 2.0


def test_cluster_samples_bounded_and_deterministic(spark):
    a = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("cluster"))
    s1 = sorted(tuple(r) for r in C.cluster_samples(a, 2).collect())
    s2 = sorted(tuple(r) for r in C.cluster_samples(a.repartition(5), 2).collect())
    assert s1 == s2 and 3 <= len(s1) <= 6


def test_power_iteration_two_cliques(spark):
    rows = []
    for base in (0, 10):
        for i in range(5):
            for j in range(i + 1, 5):
                rows.append((base + i, base + j, 1.0))
    rows.append((4, 10, 0.01))
    labels = {r["id"]: r["cluster"] for r in C.power_iteration_clusters(edges(spark, rows), 2, max_iter=20).collect()}
    assert len({labels[i] for i in range(5)}) == 1
    assert len({labels[i] for i in range(10, 15)}) == 1
    assert labels[0] != labels[10]


@pytest.mark.parametrize("weighted", [True, False])
def test_rank_with_and_without_salts(spark, weighted):
    e = edges(spark, [(2, k, 1.0 + k) for k in range(10, 60)] + [(k, 2, 1.0) for k in range(10, 60)])
    plain = as_map(R.personal_rank(e, 2, 0.85, 6, weighted=weighted), ("id",), "rank")
    salted = as_map(R.personal_rank(e, 2, 0.85, 6, weighted=weighted, rows_per_salt=3), ("id",), "rank")
    assert plain.keys() == salted.keys()
    for k, v in plain.items():
        assert salted[k] == pytest.approx(v, rel=1e-12)


def test_rank_of_folded_ids_has_kinds(spark):
    e = edges(spark, [(14, 7, 1.0), (7, 14, 1.0)])  # user 7 and shop 3
    ranks = R.personal_rank(e, 14, 0.85, 3)
    assert {r["id"]: r["kind"] for r in ranks.collect()} == {14: "user", 7: "shop"}
    assert [r["id"] for r in R.top_shops(ranks).collect()] == [7]
    from shopweave.plans.recommend import named

    assert {r["id"] for r in named(ranks).collect()} == {"u7", "s3"}


def test_top_shops_orders_by_raw_rank(spark):
    ranks = spark.createDataFrame([("s9", "shop", 4e-10), ("s1", "shop", 1e-12), ("s2", "shop", 1e-13)], "id string, kind string, rank double")
    assert [r["id"] for r in R.top_shops(ranks, 2).collect()] == ["s9", "s1"]
    many = ranks.withColumn("seed", F.lit("u1"))
    assert [r["id"] for r in R.top_shops_many(many, 2).orderBy("pos").collect()] == ["s9", "s1"]


def test_small_edges_are_kept(spark):
    events = spark.createDataFrame([(1, 1, 3e-10), (1, 2, 0.0)], "user_id long, shop_id long, weight double")
    assert [(r["dst"], r["weight"]) for r in G.user_shop_edges(events, False).collect()] == [("s1", 3e-10)]


def test_rounding_passes_special_values(spark):
    from shopweave.functions.core import round6, round9

    inf = float("inf")
    df = spark.createDataFrame([(inf,), (-inf,), (float("nan"),), (2e10,), (1.25,), (None,)], "x double")
    got = [tuple(r) for r in df.select(round6("x"), round9("x")).collect()]
    assert got[0] == (inf, inf) and got[1] == (-inf, -inf) and all(map(math.isnan, got[2]))
    assert got[3] == (2e10, 2e10) and got[4] == (1.25, 1.25) and got[5] == (None, None)


def skewed(spark, n=20_000):
    return spark.range(n).select(F.when(F.col("id") < 0.8 * n, 7).otherwise(F.col("id")).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_heavy_keys_are_spread(spark):
    from shopweave.operators.skew import heavy_keys, salted, skew_join

    large = skewed(spark)
    heavy = heavy_keys(large, "src", 1000)
    assert [tuple(r) for r in heavy.collect()] == [(7, 16)]
    sizes = salted(large, heavy, "src", ["dst"]).groupBy("src", "_salt").count().agg(F.max("count")).first()[0]
    assert sizes < 1300
    small = large.groupBy("src").agg(F.sum("weight").alias("total"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "16")):
            spark.conf.set(k, v)
        plain = large.join(small, "src")
        spread = skew_join(large, small, "src", rows_per_salt=1000)
        assert spread.count() == plain.count() == 20_000
        assert largest_task(plain) >= 16_000 and largest_task(spread) < 6_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_skewed_graph_operators_agree(spark):
    e = skewed(spark, 2000)
    want = as_map(G.normalize_out_weights(e))
    assert as_map(G.normalize_out_weights(e, rows_per_salt=50)) == want and want[(7, 0)] == pytest.approx(1 / 1600)
    us = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1.0 / (F.col("dst") + 1)).alias("weight"))
    hubs = {r["shop_id"]: (r["hub"], r["hub_weight"]) for r in S.shop_hubs(us, rows_per_salt=50).collect()}
    assert hubs[7] == (0, 1.0) and hubs[1999] == (1999, 1 / 2000)
    assert sorted(map(tuple, S.hub_similarity(us, rows_per_salt=50).collect())) == sorted(map(tuple, S.hub_similarity(us).collect()))
    labels = spark.range(2000).select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    assert sorted(map(tuple, C.label_edges(e, labels, rows_per_salt=50).collect())) == sorted(map(tuple, C.label_edges(e, labels).collect()))


def test_one_scan_per_table(spark):
    from shopweave.plans import registry

    df = registry.queries()["edges_normalized"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 0  # the pairs were aggregated once, into a stored table


def test_silhouette_counts_isolated_and_unlabelled(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 1, 1.0), (1, 9, 1.0), (9, 1, 1.0)])  # 9 has no label: cluster 0
    a = spark.createDataFrame([(1, 0), (2, 1), (5, 0), (6, 1)], "id long, cluster int")  # 5 and 6 are isolated
    got = {r["id"]: r for r in C.silhouette(e, a, spark.createDataFrame([(1,), (5,)], "id long")).collect()}
    assert set(got) == {1, 5}
    assert math.isinf(got[1]["a"]) and math.isinf(got[1]["b"]) and math.isnan(got[1]["coefficient"])
    drop = {r["id"]: r for r in C.silhouette(e, a, spark.createDataFrame([(1,), (5,)], "id long"), "drop").collect()}
    assert drop[1]["a"] == pytest.approx(0.5) and drop[1]["b"] == pytest.approx(1.0)  # 1 and 9 in cluster 0; 2 in 1
    assert drop[5]["a"] == 0.0 and drop[5]["b"] is None
    labels = {r["id"]: r["cluster"] for r in C.graph_labels(e, a).collect()}
    assert labels == {1: 0, 2: 1, 5: 0, 6: 1, 9: 0}
    per = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, coefficient double")
    assert tuple(C.mean_silhouette(per).first()) == (0.375, 2)


def test_member_sample_is_a_share(spark):
    a = spark.range(4000).select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    s1 = sorted(r["id"] for r in C.sample_members(a, 0.05).collect())
    assert s1 == sorted(r["id"] for r in C.sample_members(a.repartition(5), 0.05).collect())
    assert 120 < len(s1) < 290
    assert C.sample_members(a, 0.0).count() == 0 and C.sample_members(a, 1.0).count() == 4000


def test_auc_over_many_scores(spark):
    from shopweave.operators.models import auc, roc_auc_evaluator

    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("double").alias("y"))
    df = df.withColumn("s", F.col("s") + 0.2 * F.col("y"))
    r = auc(df, "s", "y").first()
    assert r["auc"] == pytest.approx(roc_auc_evaluator(df, "s", "y"), abs=1e-12)
    assert auc(df.filter("y = 1"), "s", "y").first()["auc"] is None


def test_splits_depend_on_keys_alone(spark):
    from shopweave.operators.models import KEYS, split_parts

    df = spark.range(2000).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("shop_id"))
    train, test = split_parts(df, KEYS)
    again, _ = split_parts(df.repartition(7), KEYS)
    key = lambda d: {tuple(r) for r in d.collect()}
    assert key(train) == key(again) and not key(train) & key(test) and len(key(train)) + len(key(test)) == 2000


def test_round_tables_are_deleted(spark, scratch):
    import os
    from shopweave.session import RoundTables

    rounds = RoundTables(spark, "t")
    for k in range(4):
        last = rounds.write(spark.range(k + 1))
    rounds.close()
    assert last.count() == 4
    path = rounds.base.removeprefix("file:")
    assert sorted(d for d in os.listdir(path) if not d.startswith(".")) == ["round-3"]
