"""Vertex programs, per-seed subgraphs and bucketed paths on small graphs, against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from shopweave.operators import clusters as C
from shopweave.operators import graph as G
from shopweave.operators import pregel as P
from shopweave.operators import rank as R
from shopweave.operators.messages import EdgeTable
from shopweave.operators.power_iteration import embedding, kmeans_line, power_clusters
from shopweave.plans.recommend import recommend_many, recommend_shops
from tests.test_graph_fixtures import TOY, as_map, edges


def random_edges(n, degree, seed=1):
    rng = random.Random(seed)
    return [(a, rng.randrange(n), round(rng.uniform(0.1, 5.0), 3)) for a in range(n) for _ in range(degree)]


def dijkstra(rows, source):
    out, dist, heap = {}, {source: 0.0}, [(0.0, source)]
    for a, b, w in rows:
        out.setdefault(a, []).append((b, w))
    done = set()
    while heap:
        d, a = heapq.heappop(heap)
        if a in done:
            continue
        done.add(a)
        for b, w in out.get(a, []):
            if d + w < dist.get(b, float("inf")):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return dist


@pytest.mark.parametrize("rows_per_salt", [3, 1_000_000])
def test_struct_state_both_directions_and_merge(spark, rows_per_salt):
    """Every vertex learns the sum of its sources' and the largest of its targets' values, as one struct message."""
    rows = [(1, 2, 1.0), (1, 3, 2.0), (2, 3, 4.0), (3, 1, 8.0)] + [(k, 1, 0.5) for k in range(10, 20)]
    e = edges(spark, rows)
    start = P.graph_vertices(e, info=F.struct(F.col("id").cast("double").alias("v"), F.lit(0.0).alias("sources"), F.lit(0.0).alias("targets")))
    forward = F.struct((F.col("s.info.v") * F.col("weight")).alias("a"), F.lit(None).cast("double").alias("b"))
    back = F.struct(F.lit(None).cast("double").alias("a"), F.col("d.info.v").alias("b"))
    merge = lambda m: F.struct(F.sum(f"{m}.a").alias("a"), F.max(f"{m}.b").alias("b"))
    new = F.struct(F.col("info.v").alias("v"), F.coalesce("msg.a", F.lit(0.0)).alias("sources"), F.coalesce("msg.b", F.lit(0.0)).alias("targets"))
    got = {r.id: (r.info.sources, r.info.targets) for r in P.pregel(start, e, {"info": new}, merge, forward, back, max_iter=1, rows_per_salt=rows_per_salt).collect()}
    for v in {x for r in rows for x in r[:2]}:
        assert got[v] == (sum(a * w for a, b, w in rows if b == v), max([float(b) for a, b, _ in rows if a == v], default=0.0))


@pytest.mark.parametrize("active,want", [("out", {2: 2, 3: 1}), ("in", {1: 1, 2: 2, 9: 1}), ("either", {1: 1, 2: 2, 3: 1, 9: 1}), ("both", {2: 1})])
def test_active_sides(spark, active, want):
    """In round 1 only vertex 2 gets a message (along the edge of weight 0); which triplets send in round 2 depends on the side."""
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (9, 2, 0.0), (3, 4, 1.0)])
    first = F.col("s.got") + F.col("d.got") == 0
    to_dst = F.when(~first | (F.col("weight") == 0), F.lit(1))
    out = P.pregel(P.graph_vertices(e, got=F.lit(0)), e, {"got": F.col("got") + 1}, F.max, to_dst, F.when(~first, F.lit(1)), active=active, max_iter=2)
    assert {r.id: r.got for r in out.collect() if r.got} == want


def test_initial_message_and_unreached_state(spark):
    e = edges(spark, [(1, 2, 1.0)])
    start = P.graph_vertices(e, n=F.lit(5))
    got = {r.id: r.n for r in P.pregel(start, e, {"n": F.col("n") + F.col("msg")}, F.sum, F.lit(100), initial=F.lit(1), max_iter=1).collect()}
    assert got == {1: 6, 2: 106}
    got = {r.id: r.n for r in P.pregel(start, e, {"n": F.col("n") + F.col("msg")}, F.sum, F.lit(100), max_iter=0).collect()}
    assert got == {1: 5, 2: 5}


def test_edges_without_a_vertex_and_nulls(spark):
    e = edges(spark, [(1, 2, 1.0), (1, 7, 1.0), (None, 2, 1.0), (2, None, 1.0)])
    start = spark.createDataFrame([(1, 0.0), (2, 0.0), (None, 0.0)], "id long, x double")
    got = {r.id: r.x for r in P.pregel(start, e, {"x": F.col("x") + F.col("msg")}, F.sum, F.col("weight"), max_iter=1).collect()}
    assert got == {1: 0.0, 2: 1.0, None: 0.0}


def test_wrong_programs(spark):
    e = edges(spark, TOY)
    v = P.graph_vertices(e, x=F.lit(0.0))
    with pytest.raises(ValueError):
        P.pregel(v, e, {}, F.sum, F.lit(1), active="sideways")
    with pytest.raises(ValueError):
        P.pregel(v, e, {}, F.sum)
    with pytest.raises(ValueError):
        P.pregel(v.withColumn("msg", F.lit(1)), e, {}, F.sum, F.lit(1))


def test_programs_equal_the_operators(spark):
    e = edges(spark, TOY + [(1, 2, 0.3)])
    rounded = lambda df: sorted(tuple(round(x, 12) for x in r) for r in df.collect())
    assert rounded(P.out_weight_normalized(e)) == rounded(G.normalize_out_weights(e))
    n = G.normalize_out_weights(e)
    for weighted in (True, False):
        want = {r.id: r.rank for r in R.personal_rank(n, 1, 0.85, 4, weighted).collect()}
        got = {r.id: r["rank"] for r in P.rank_program(n, 1, 0.85, 4, weighted).filter("rank > 0").collect()}
        assert got == pytest.approx(want, abs=1e-12)
    got = {r.id: r.dist for r in P.path_program(e, 1).collect()}
    assert got == pytest.approx(dijkstra(TOY + [(1, 2, 0.3)], 1))


def test_edges_are_not_shuffled_in_a_round(spark):
    table = EdgeTable(edges(spark, random_edges(50, 4)).withColumnRenamed("weight", "w"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        active = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, value double")
        plan = table.send(active, [], F.col("value") * F.col("w"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the exchange is the active vertices'
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.close()


@pytest.mark.parametrize("delta", [0.5, 2.0, 1e9, None])
def test_paths_by_buckets(spark, delta):
    rows = random_edges(40, 3) + [(k, k + 1, 0.11) for k in range(39)]
    src = spark.createDataFrame([(0,), (7,), (0,)], "source long")
    got = as_map(C.shortest_paths(edges(spark, rows), src, delta), ("source", "id"), "dist")
    want = {(s, v): d for s in (0, 7) for v, d in dijkstra(rows, s).items()}
    assert got == pytest.approx(want)


def test_paths_without_edges_or_sources(spark):
    e = edges(spark, [(1, 2, 1.0)])
    assert C.shortest_paths(e, spark.createDataFrame([], "source long")).count() == 0
    assert as_map(C.shortest_paths(e.limit(0), spark.createDataFrame([(5,)], "source long")), ("source", "id"), "dist") == {(5, 5): 0.0}


def test_batches_of_sources_give_the_same_summary(spark):
    rows = random_edges(20, 3, 5)
    e, src = edges(spark, rows), spark.range(0, 20, 3).select(F.col("id").alias("source"))
    members = spark.range(20).select("id", (F.col("id") % 4).cast("int").alias("cluster"))
    rounded = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    want = rounded(C.distance_summary(C.shortest_paths(e, src), members))
    assert rounded(C.path_summary(e, src, members, 70)) == want


def shopping(spark):
    rng = random.Random(6)
    shop = [(s, f"city{s % 4}") for s in range(24)]
    logs = [[(u, rng.choice([s for s in range(24) if s % 4 in (u % 4, (u * 3 + 1) % 4)]), f"2000-0{rng.randint(1, 9)}-11 10:00:00") for u in range(30) for _ in range(k)] for k in (5, 2)]
    frames = [spark.createDataFrame(x, "user_id long, shop_id long, t string").select("user_id", "shop_id", F.col("t").cast("timestamp_ntz").alias("ts")) for x in logs]
    return *frames, spark.createDataFrame(shop, "shop_id long, city string")


@pytest.mark.parametrize("weighted", [True, False])
def test_recommendations_for_many_equal_single_ones(spark, weighted):
    pay, view, shop = shopping(spark)
    users = spark.createDataFrame([(0,), (5,), (18,), (5,), (999,)], "user_id long")
    got = recommend_many(pay, view, shop, users, "2000-01-01", "2001-01-01", 5, max_iter=4, weighted=weighted).orderBy("user_id", "pos").collect()
    assert {r.user_id for r in got} == {0, 5, 18}
    for u in (0, 5, 18):
        single = recommend_shops(pay, view, shop, u, "2000-01-01", "2001-01-01", 5, max_iter=4, weighted=weighted).collect()
        mine = [r for r in got if r.user_id == u]
        assert [r.id for r in mine] == [r.id for r in single]
        assert [r["rank"] for r in mine] == pytest.approx([r["rank"] for r in single], abs=1e-12)


def planted(n, k, seed=3):
    rng = random.Random(seed)
    size = n // k
    inside = [(a, size * (a // size) + rng.randrange(size), 1.0) for a in range(n) for _ in range(12)]
    across = [(rng.randrange(n), rng.randrange(n), 1.0) for _ in range(n // 50)]
    return [(min(a, b), max(a, b), w) for a, b, w in inside + across if a != b]


def test_planted_clusters_are_found_alike_on_every_layout(spark):
    rows, found = planted(1000, 4), []
    for parts in (1, 4, 8):
        labels = {r.id: r.cluster for r in power_clusters(edges(spark, rows).repartition(parts), 4, 12).collect()}
        found.append(labels)
    assert found[0] == found[1] == found[2] and len(found[0]) == 1000
    blocks = [{found[0][v] for v in range(b, b + 250)} for b in range(0, 1000, 250)]
    assert all(len(b) == 1 for b in blocks) and len(set().union(*blocks)) == 4


def test_embedding_against_plain_python(spark):
    rows = [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 0.5), (4, 3, 1.0), (1, 2, 1.0), (5, 5, 9.0), (6, None, 1.0), (7, 8, None)]
    start = {r.id: r.x for r in embedding(edges(spark, rows), 0).collect()}
    w = {}
    for a, b, x in rows[:5]:
        w[a, b] = w.get((a, b), 0) + x
        w[b, a] = w.get((b, a), 0) + x
    v = dict(start)
    assert set(v) == {1, 2, 3, 4}
    for _ in range(5):
        u = {i: sum(x * v[b] for (a, b), x in w.items() if a == i) / sum(x for (a, _), x in w.items() if a == i) for i in v}
        size = sum(map(abs, u.values()))
        v = {i: x / size * len(v) for i, x in u.items()}
    got = {r.id: r.x for r in embedding(edges(spark, rows), 5).collect()}
    assert got == pytest.approx(v, abs=1e-12)
    assert embedding(edges(spark, []), 3).count() == 0


def test_clusters_on_the_line(spark):
    values = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])], "id long, x double")
    assert [r.cluster for r in kmeans_line(values, 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 2]
    same = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, x double")
    assert {r.cluster for r in kmeans_line(same, 3).collect()} == {0}
    assert kmeans_line(values.limit(0), 3).count() == 0


def test_failed_rounds_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    e = edges(spark, TOY)
    bad = F.when(F.col("s.x") > 1, F.raise_error(F.lit("stop"))).otherwise(F.lit(2.0))
    with pytest.raises(Exception, match="stop"):
        P.pregel(P.graph_vertices(e, x=F.lit(0.0)), e, {"x": F.col("msg")}, F.max, bad).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
