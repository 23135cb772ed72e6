"""Steps that were rewritten to scale: same results, and plans without the work that grew."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shopweave.operators import clusters as C
from shopweave.operators import graph as G
from shopweave.operators import pregel as P
from shopweave.operators.messages import HASH_ROWS, EdgeTable, PlacedEdges
from shopweave.operators.power_iteration import power_clusters
from shopweave.session import partial_keys, stored
from tests.conftest import SF_SMALL
from tests.test_graph_fixtures import TOY, edges
from tests.test_vertex_programs import dijkstra, planted, random_edges


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_hash_senders_and_do_not_sort_edges(spark):
    rows = random_edges(50, 4)
    table = EdgeTable(edges(spark, rows).withColumnRenamed("weight", "w"), rows_per_salt=3)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        active = spark.createDataFrame([(v, 1.0) for v in range(50)], "id long, value double")
        few, many = (table.send(active, [], F.col("value") * F.col("w"), n) for n in (50, HASH_ROWS * table.tasks + 1))
        assert "ShuffledHashJoin" in executed(few) and "Sort [" not in executed(few)
        assert "SortMergeJoin" in executed(many)  # too many to hash
        key = lambda df: sorted((r.id, r.value) for r in df.collect())
        assert key(few) == key(many) == sorted((b, w) for _, b, w in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.close()


def test_all_triplets_send_and_refused_messages_change_nothing(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0)])
    start = P.graph_vertices(e, n=F.lit(0))
    count = {"n": F.col("n") + F.col("msg")}
    got = {r.id: r.n for r in P.pregel(start, e, count, F.sum, F.lit(1), active="all", reads_target=False, max_iter=3).collect()}
    assert got == {1: 0, 2: 3, 3: 3}  # vertex 1 never gets a message and sends all the same
    got = {r.id: r.n for r in P.pregel(start, e, count, F.sum, F.lit(1), active="all", accepts=F.col("n") + F.col("msg") < 3).collect()}
    assert got == {1: 0, 2: 2, 3: 2}  # and the loop ends when none is taken


@pytest.mark.parametrize("weighted", [True, False])
def test_rank_program_keeps_sources_without_edges_into_them(spark, weighted):
    e = edges(spark, [(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0), (3, 2, 1.0)])
    r = {v: 0.15 if v == 1 else 0.0 for v in (1, 2, 3)}
    for _ in range(4):
        r = {1: 0.15, 2: 0.85 * (r[1] * 0.5 + r[3]), 3: 0.85 * (r[1] * 0.5 + r[2])}
    got = {x.id: x["rank"] for x in P.rank_program(e, 1, 0.85, 4, weighted).collect()}
    assert got == pytest.approx(r, abs=1e-12)


def test_path_program_does_not_join_triplets_with_targets(spark, monkeypatch):
    rows, seen = random_edges(30, 3) + [(k, k + 1, 0.11) for k in range(29)], []
    plain = P.salted
    monkeypatch.setattr(P, "salted", lambda *a: seen.append(a) or plain(*a))
    got = {r.id: r.dist for r in P.path_program(edges(spark, rows), 0).collect()}
    assert got == pytest.approx(dijkstra(rows, 0)) and not seen


def test_normalisation_writes_its_edges_once(spark, monkeypatch):
    made = []

    class Counted(EdgeTable):
        def __init__(self, *a, **k):
            made.append(1)
            super().__init__(*a, **k)

    monkeypatch.setattr(P, "EdgeTable", Counted)
    e = edges(spark, TOY)
    key = lambda df: sorted(tuple(round(x, 12) for x in r) for r in df.collect())
    assert key(P.out_weight_normalized(e)) == key(G.normalize_out_weights(e)) and len(made) == 1


def test_edge_lists_are_merged_before_they_are_mirrored_and_named(spark):
    plan = executed(E.queries()["edges_union"](spark, SF_SMALL))
    assert 0 <= plan.index("Generate") < plan.index("HashAggregate")  # the plan's top comes first
    assert plan.count("Generate") == 1


def test_mirrored_pairs_with_nulls(spark):
    """The same edges as when each list is mirrored first: the pair of two nulls merges with its mirror."""
    rows = [(1, 2, 0.5, 2), (None, 2, 1.0, 1), (1, None, 2.0, 1), (None, None, 4.0, 1)]
    got = G.mirror_merged(spark.createDataFrame(rows, "user_id long, shop_id long, weight double, n_lists long"))
    want = [("u1", "s2", 0.5, 2), ("s2", "u1", 0.5, 2), (None, "s2", 1.0, 1), ("s2", None, 1.0, 1), ("u1", None, 2.0, 1), (None, "u1", 2.0, 1), (None, None, 8.0, 2)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_power_iteration_runs_by_message_rounds(spark):
    rows = planted(200, 4)
    e = edges(spark, rows)
    want = {r.id: r.cluster for r in power_clusters(e, 4, 12).collect()}
    assert {r.id: r.cluster for r in C.power_iteration_clusters(e, 4, 12).collect()} == want
    by_degree = {r.id: r.cluster for r in C.power_iteration_clusters(e, 4, 3, "degree").collect()}
    assert by_degree.keys() == want.keys() and set(by_degree.values()) <= set(range(4))


def test_power_iteration_of_odd_pairs(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (4, 4, 5.0), (5, 6, 0.0), (1, 6, 0.0)]
    labels = {r.id: r.cluster for r in C.power_iteration_clusters(edges(spark, rows), 2).collect()}
    assert labels.keys() == {1, 2, 3, 5, 6} and labels[5] == labels[6] != labels[2]
    with pytest.raises(ValueError):
        C.power_iteration_clusters(edges(spark, [(1, 2, -1.0)]), 2)
    with pytest.raises(ValueError):
        C.power_iteration_clusters(edges(spark, rows), 2, init_mode="none")


def test_edges_of_hubs_lie_with_their_targets(spark):
    """Rounds of paths: a hub's row goes to each place once, and a target's messages come from one place."""
    rows = [(h, u, 1.0 + (h * u) % 7) for h in range(5) for u in range(100, 400)]
    rows += [(u, h, w) for h, u, w in rows] + [(1, None, 1.0)]
    table = PlacedEdges(edges(spark, rows).withColumnRenamed("weight", "w"))
    try:
        places = {(r.src, r.dst): r._place for r in table.edges.collect()}
        assert len(places) == len(rows)
        for u in range(100, 400):
            assert len({places[e] for h in range(5) for e in ((h, u), (u, h))}) == 1
        assert table.places.filter("src < 5").count() <= 5 * table.tasks
        senders = spark.createDataFrame([(v, 1.0) for v in [*range(5), *range(100, 400), 999]], "src long, dist double")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with partial_keys(spark):
            sent = table.triplets(senders, senders.count())
            assert "disabled by query planner" not in executed(sent)  # the edges stay in their buckets
            assert sorted((r.src, str(r.dst), r.w) for r in sent.collect()) == sorted((a, str(b), w) for a, b, w in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.close()


def test_home_clusters_read_their_edges_once(spark):
    nan = float("nan")
    rows = [(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.1), (2, 12, nan), (2, 10, 9.0), (3, None, 2.0), (3, 11, 2.0)]
    rows += [(4, None, 2.0), (4, 11, 1.0), (5, 11, None), (5, 12, -1.0), (6, 10, None), (None, 10, 1.0), (7, 99, 1.0), (8, 10, 0.0), (8, 9, -0.0)]
    shop = spark.createDataFrame([(s, s * 10) for s in (9, 10, 11, 12)], "shop_id long, location_id int")
    got = C.home_city_clusters(stored(edges(spark, rows), "user-shop"), shop)
    assert executed(got).count("FileScan") == 1 and "Subquery" not in executed(got)
    assert {r.id: r.cluster for r in got.collect()} == {1: 100, 2: 120, 3: 110, 5: 120, 8: 90}
