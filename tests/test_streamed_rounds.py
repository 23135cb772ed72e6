"""Rounds of a chunk of sources inside one task, past streamed edges; and what their queries serve."""

import os

import pytest
from pyspark.sql import functions as F

from shopweave.operators import clusters as C
from shopweave.operators import rank as R
from shopweave.operators import streams as S
from shopweave.operators.power_iteration import embedding
from shopweave.plans import registry
from shopweave.session import ensure_checkpoint_dir, stored
from tests.test_graph_fixtures import edges
from tests.test_vertex_programs import dijkstra, planted, random_edges, shopping


def kept(spark):
    """Tables in the shared folder that hold rows."""
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {d for d, _, names in os.walk(top) if any(n.endswith(".parquet") for n in names)}


def test_tables_and_shuffles_go_when_they_are_spent(spark):
    """they lay on disk until the session ended."""
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    before, files = kept(spark), blocks.getAllFiles().size()
    pairs = stored(edges(spark, planted(100, 2)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "pairs")
    assert blocks.getAllFiles().size() <= files
    rows = embedding(pairs, 2)
    assert len(kept(spark) - before) == 2 and rows.count() == 100  # the pairs and the last round
    rows = random_edges(30, 3)
    e = stored(edges(spark, rows), "similarity")
    got = {r.id: r.dist for r in C.shortest_paths(e, spark.createDataFrame([(0,)], "source long"), spent=[e]).collect()}
    assert got.keys() == dijkstra(rows, 0).keys() and not any("similarity" in d for d in kept(spark) - before)


def test_recommend_many_serves_every_user(spark, monkeypatch):
    """only users with an id divisible by 100 were served."""
    pay, view, shop = shopping(spark)
    monkeypatch.setattr(registry, "_logs", lambda *a: (pay, view, shop))
    got = {r.user_id for r in registry.queries()["recommend_many"](spark, "").select("user_id").distinct().collect()}
    assert got == {r.user_id for r in pay.union(view).select("user_id").distinct().collect()} and len(got) == 30
    assert {r.user_id for r in registry.queries()["recommend_many_unweighted"](spark, "").collect()} == {0}


@pytest.mark.parametrize("rounds", [3, 24])
def test_streamed_paths_of_chunks_and_pieces(spark, monkeypatch, rounds):
    """distances of sources x vertices were written and dealt out in every round."""
    monkeypatch.setattr(S, "PIECE_EDGES", 20)
    monkeypatch.setattr(S, "MAX_WIDTH", 3)
    monkeypatch.setattr(S, "STEP", 64)
    rows = random_edges(40, 3) + [(k, k + 1, 0.11) for k in range(39)] + [(99, v, 0.5) for v in range(40)]
    e = stored(edges(spark, rows).groupBy("src", "dst").agg(F.min("weight").alias("w")), "edges")
    labels = [(v, v % 3) for v in range(40)] + [(99, S.NULL_ID), (500, 1), (7, 5), (8, 2)]
    sources = stored(spark.createDataFrame([(s,) for s in (0, 7, 8, 9, 11, 30, 39, 99, 500, 600)], "source long"), "sources")
    members = stored(spark.createDataFrame(labels, "id long, cluster long"), "members")
    got = {}
    for r in S.summed_paths(e, S.greater_ends(e), sources, members, rounds).collect():
        n, total = got.get((r.source, r.cluster), (0, 0.0))
        got[r.source, r.cluster] = (n + r.reached, total + r.total)
    want = {}
    for s in (0, 7, 8, 9, 11, 30, 39, 99, 500):
        for v, d in (dijkstra(rows, s) if s < 500 else {500: 0.0}).items():
            for m, c in labels:
                if m == v:
                    n, total = want.get((s, c), (0, 0.0))
                    want[s, c] = (n + 1, total + d)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_paths_of_many_sources_are_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(C, "VectorGraph", None)
    members = spark.createDataFrame([(v, v % 4 if v % 5 else None) for v in range(20)], "id long, cluster int")
    src, rows = spark.range(0, 20, 3).select(F.col("id").alias("source")), random_edges(20, 3, 5)
    rounded = lambda df: sorted((str(tuple(round(x, 9) if x else x for x in r)) for r in df.collect()))
    summary = C.path_summary(edges(spark, rows), src, members)
    assert rounded(summary) == rounded(C.distance_summary(C.shortest_paths(edges(spark, rows), src), members))
    assert dict(summary.dtypes)["cluster"] == "int"


def pushed(rows, seed, eps, d, rounds):
    """Forward push by hand; edges to None are kept, edges from it send nothing."""
    degree, rank, left = {}, {}, {seed: 1 - d}
    for a, _, _ in rows:
        degree[a] = degree.get(a, 0) + 1
    for _ in range(rounds):
        now = {v: x for v, x in left.items() if x > eps * max(1, degree.get(v, 0) if v is not None else 0)}
        for v, x in now.items():
            rank[v], left[v] = rank.get(v, 0) + x, left[v] - x
        for v, x in now.items():
            for a, b, w in rows:
                if a == v and a is not None:
                    left[b] = left.get(b, 0) + d * x * w
    return {v: (x, left[v]) for v, x in rank.items()}


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_pushes_stay_in_tasks(spark, monkeypatch, rounds):
    """ranks and residuals of seeds x vertices were written and dealt out in every round."""
    monkeypatch.setattr(R, "VectorGraph", None)
    monkeypatch.setattr(S, "PIECE_EDGES", 20)
    monkeypatch.setattr(S, "LEAST_WIDTH", 2)
    rows = [(a, b, w / 9) for a, b, w in random_edges(30, 3, 2)] + [(3, None, 0.2), (None, 4, 0.5), (7, None, 0.1)]
    seeds = spark.range(0, 6).select(F.col("id").alias("seed"))
    ranks, report = R.push_rank_many(edges(spark, rows), seeds, 1e-3, 0.85, max_rounds=rounds)
    got = {(r.seed, r.id): (r["rank"], r.residual) for r in ranks.collect()}
    want = {(s, v): x for s in range(6) for v, x in pushed(rows, s, 1e-3, 0.85, rounds).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert report["rows"] == len(want) and report["rounds"] == rounds


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("rounds", [0, 1, 4, 5])
def test_ranks_on_subgraphs_stay_in_tasks(spark, monkeypatch, weighted, rounds):
    """ranks and gates of seeds x vertices were written and dealt out in every round."""
    monkeypatch.setattr(R, "VectorGraph", None)
    monkeypatch.setattr(S, "PIECE_EDGES", 20)
    monkeypatch.setattr(S, "LEAST_WIDTH", 2)
    pairs = sorted({(u, (u * u + 3 * j) % 11) for u in range(20) for j in range(4)})
    rows = [e for u, s in pairs for e in ((2 * u, 2 * s + 1, 0.1 + (u + s) % 3 / 10), (2 * s + 1, 2 * u, 0.05 + u % 4 / 20))]
    city = {2 * s + 1: s % 3 for s in range(11)}
    may = {0: {0}, 6: {0, 2}, 10: {1}, 38: set()}
    seeds = spark.createDataFrame([(s,) for s in [*may, 1000]], "seed long")
    allowed = spark.createDataFrame([(s, v) for s, c in may.items() for v in city if city[v] in c], "seed long, id long")
    got = {(r.seed, r.id): r["rank"] for r in R.personal_rank_subgraphs(edges(spark, rows), seeds, allowed, 0.85, rounds, weighted).collect()}
    want = {}
    for s, cities in may.items():
        sub = [(a, b, w) for a, b, w in rows if city.get(a if a % 2 else b) in cities]
        out = {a: sum(x[0] == a for x in sub) for a, _, _ in sub}
        r = {s: 0.15}
        for _ in range(rounds):
            new = {s: 0.15}
            for a, b, w in sub:
                if a in r:
                    new[b] = new.get(b, 0.0) + 0.85 * r[a] * (w if weighted else 1 / out[a])
            r = new
        want |= {(s, v): x for v, x in r.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
