"""Cluster assignments, cut weight, shortest paths and the silhouette coefficient on graphs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.functions.core import md5_fraction
from shopweave.operators.messages import PlacedEdges
from shopweave.operators.skew import ROWS_PER_SALT, heavy_keys, skew_join
from shopweave.operators.streams import NULL_ID, SENT_COVER, greater_ends, summed_paths
from shopweave.operators.vectors import VectorGraph, packed_batches, vector_paths
from shopweave.session import BucketedTable, RoundTables, ensure_checkpoint_dir, partial_keys, stored

#: Width of a bucket of path rounds, in mean edges.
DELTA_EDGES = 4.0
#: Distances that the batches of ``path_summary`` hold at a time.
STATE_ROWS = 200_000_000


def home_city_clusters(user_shop: DataFrame, shop: DataFrame) -> DataFrame:
    """A deterministic clustering: each user's cluster is the location of its heaviest shop.

    (id, cluster); ties in weight go to the smaller shop id. One aggregation that combines on the map side: the edges are
    read once, and a user's best so far is all that is shuffled of it.
    """
    weight, shop_id = F.col("weight"), F.col("dst")
    best = F.min(F.struct((~F.isnan(weight)).alias("number"), (-weight).alias("weight"), shop_id.isNull().alias("no_shop"), shop_id.alias("shop_id")))
    known = user_shop.filter(F.col("src").isNotNull() & weight.isNotNull())  # NaN is the largest weight; of equal ones a null shop comes last
    home = known.groupBy(F.col("src").alias("id")).agg(best.alias("best")).select("id", "best.shop_id")
    return home.join(shop.select("shop_id", F.col("location_id").alias("cluster")), "shop_id").select("id", F.col("cluster").cast("int"))


def label_edges(edges: DataFrame, assignments: DataFrame, default: int = 0, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Attach the cluster of both endpoints; vertices without a label get ``default``.

    Edges of a hub are spread over salts on either side. Pass stored edges.
    """
    heavy = heavy_keys(edges, "dst", rows_per_salt)
    a_src = assignments.select(F.col("id").alias("src"), F.col("cluster").alias("c_src"))
    a_dst = assignments.select(F.col("id").alias("dst"), F.col("cluster").alias("c_dst"))
    e = skew_join(edges.select("src", "dst", "weight"), a_src, "src", "left", rows_per_salt)
    e = skew_join(e, a_dst, "dst", "left", heavy=heavy)
    return e.select(
        "src", "dst", "weight",
        F.coalesce("c_src", F.lit(default)).alias("c_src"),
        F.coalesce("c_dst", F.lit(default)).alias("c_dst"),
    )


def cut_weight(edges: DataFrame, assignments: DataFrame, default: int = 0) -> DataFrame:
    """Sum of weights of edges whose endpoints lie in different clusters (one row).

    Each direction of a pair counts with its own weight. Also returns the total
    weight and the number of cut edges.
    """
    return cut_sums(label_edges(edges, assignments, default))


def cut_sums(e: DataFrame) -> DataFrame:
    """``cut_weight``'s row of labelled edges."""
    cut = F.col("c_src") != F.col("c_dst")
    return e.agg(
        F.sum(F.when(cut, F.col("weight")).otherwise(F.lit(0.0))).alias("cut_weight"),
        F.sum("weight").alias("total_weight"),
        F.sum(F.when(cut, 1).otherwise(0)).cast("long").alias("cut_edges"),
        F.count(F.lit(1)).alias("edges"),
    )


def write_labelled_edges(edges: DataFrame, assignments: DataFrame, path: str, default: int = 0) -> DataFrame:
    """``label_edges`` written to ``path``; returns ``cut_weight``'s row, summed up from the three columns written that it needs.

    (Metrics observed during the write would spare that scan, but a session that has observed any can't run
    the models of ``pyspark.ml`` any more: Spark then fails to serialise it.)
    """
    label_edges(edges, assignments, default).write.mode("overwrite").parquet(path)
    return cut_sums(edges.sparkSession.read.parquet(path))


def to_distances(edges: DataFrame) -> DataFrame:
    """Edge length = 1 / weight."""
    return edges.select("src", "dst", (F.lit(1.0) / F.col("weight")).alias("weight"))


def shortest_edges(edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT, spent: Sequence[DataFrame] = ()) -> PlacedEdges:
    """The edges for path rounds: of parallel edges only the shortest is kept."""
    return PlacedEdges(edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("w")), rows_per_salt, spent)


def shortest_paths(
    edges: DataFrame, sources: DataFrame, delta: float | None = None, rows_per_salt: int = ROWS_PER_SALT, spent: Sequence[DataFrame] = ()
) -> DataFrame:
    """Directed shortest distances from every ``sources(source)`` vertex: (source, id, dist).

    Unreachable vertices are absent (distance +inf). Weights must be positive. See ``bucketed_paths``. ``spent``: stored tables
    that only ``edges`` is made of; they are deleted once it has been read.
    """
    table = shortest_edges(edges, rows_per_salt, spent)
    try:
        return bucketed_paths(table, sources, delta)
    finally:
        table.close()


def vertex_count(table: PlacedEdges) -> int:
    return table.base.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()


def bucketed_paths(table: PlacedEdges, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """Shortest paths over a frontier, by buckets of distance ``delta`` wide (None: DELTA_EDGES mean edges).

    All sources share one log of (source, id, dist), bucketed by (source, id). A round sends from the pairs that
    the round before bettered below the bucket's limit, and appends the pairs that its messages better; pairs beyond the
    limit wait until no pair below it changes. Once a source has reached every vertex, ways longer than its farthest one are not
    sent. What a round shuffles is its frontier and its messages: the log is read in place. It holds a row for each time that a
    pair got better.
    """
    spark = sources.sparkSession
    if delta is None:
        delta = DELTA_EDGES * (table.base.agg(F.avg("w")).first()[0] or 1.0)
    n_ends = vertex_count(table)
    table.forget_base()
    log = BucketedTable(spark, "paths", ["source", "id"], table.tasks, "round")
    ends = RoundTables(spark, "farthest")
    try:
        log.append(sources.select("source").distinct().select("source", F.col("source").alias("id"), F.lit(0.0).alias("dist"), F.lit(0).alias("round")))
        k, limit, frontier = 0, delta, log.read()
        senders = frontier.count()
        while True:
            k += 1
            best = log.read().groupBy("source", "id").agg(F.min("dist").alias("best"))
            farthest = best.groupBy("source").agg(F.count(F.lit(1)).alias("reached"), F.max("best").alias("farthest"))
            farthest = ends.write(farthest.filter(F.col("reached") >= n_ends))  # few rows of known size: the frontier needn't be shuffled to them
            useful = frontier.join(farthest, "source", "left").select("source", F.col("id").alias("src"), "dist", "farthest")
            sent = table.triplets(useful, senders).withColumn("way", F.col("dist") + F.col("w")).filter("farthest is null or way < farthest")
            near = sent.groupBy("source", F.col("dst").alias("id")).agg(F.min("way").alias("dist"))
            better = near.join(best, ["source", "id"], "left").filter("best is null or dist < best").select("source", "id", "dist", F.lit(k).alias("round"))
            with partial_keys(spark):
                log.append(better)
            frontier = log.read().filter((F.col("round") == k) & (F.col("dist") < limit))
            senders = frontier.count()
            if not senders:
                waiting = log.read().groupBy("source", "id").agg(F.min("dist").alias("dist")).filter(F.col("dist") >= limit)
                first = waiting.agg(F.min("dist")).first()[0]
                if first is None:
                    return stored(log.read().groupBy("source", "id").agg(F.min("dist").alias("dist")), "distances")
                limit = first + delta
                frontier = waiting.filter(F.col("dist") < limit)
                senders = frontier.count()
    finally:
        ends.close()
        log.close()


def path_summary(edges: DataFrame, sources: DataFrame, members: DataFrame, state_rows: int = STATE_ROWS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``distance_summary`` of many sources, whose distances are never written.

    A task takes a chunk of sources, streams the edges past their distances (``streams``) and folds these to a row per
    (source, cluster). Ids that are no whole numbers, and graphs without a small cover, go in batches, so that sources ×
    vertices stays near ``state_rows``, what the shared folder holds of distances at a time; a batch's rounds are
    ``vectors``': a vertex holds its distances from a chunk of sources as one array.
    """
    spark = edges.sparkSession
    short = stored(edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("w")), "edges")
    known = short.filter("src is not null and dst is not null and w is not null")
    sources = stored(sources.select("source").distinct(), "sources")
    kinds = [*dict(known.select("src", "dst").dtypes).values(), *dict(sources.dtypes).values(), *dict(members.select("id", "cluster").dtypes).values()]
    if all(k in ("tinyint", "smallint", "int", "bigint") for k in kinds):
        cover = greater_ends(known)
        if cover.count() <= SENT_COVER:
            return _streamed_summary(known, short, cover, sources, members)
    return _dealt_summary(known, sources, members, state_rows, rows_per_salt)


def _streamed_summary(edges: DataFrame, table: DataFrame, cover: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """By ``streams``: distances stay in the tasks."""
    long = lambda c: F.col(c).cast("long").alias(c)
    label = F.coalesce(F.col("cluster").cast("long"), F.lit(NULL_ID)).alias("cluster")
    marks = stored(members.filter("id is not null").select(long("id"), label), "members")
    starts = sources.filter("source is not null").select(long("source"))
    parts = summed_paths(edges.select(long("src"), long("dst"), "w"), cover.select(long("id")), starts, marks, spent=[table, cover])
    names = {c: (dict(sources.dtypes) | dict(members.dtypes))[c] for c in ("source", "cluster")}
    whole = parts.groupBy("source", "cluster").agg(F.sum("reached").alias("reached"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("total").alias("total"))
    known = F.when(F.col("cluster") != NULL_ID, F.col("cluster")).cast(names["cluster"]).alias("cluster")
    return whole.select(F.col("source").cast(names["source"]).alias("source"), known, "reached", "nearest", "farthest", "total")


def _dealt_summary(short: DataFrame, sources: DataFrame, members: DataFrame, state_rows: int, rows_per_salt: int) -> DataFrame:
    """By ``vectors``, for ids that are no numbers, or a cover too large for a task: batches of sources, dealt out in every round."""
    spark = short.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/summary-{uuid.uuid4().hex}"
    ends = short.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(sources.filter("source is not null").select(F.col("source").alias("id")))
    vertices = stored(ends.distinct().withColumn("info", F.lit(0.0)), "ends")
    n = sources.count()
    batches = max(1, math.ceil(n * vertices.count() / state_rows))
    graph = VectorGraph(short, vertices, math.ceil(n / batches), rows_per_salt)
    for b in range(batches):
        dist = vector_paths(graph.chunked(sources.filter(F.pmod(F.xxhash64("source"), F.lit(batches)) == b)))
        out = distance_summary(dist, members)
        with packed_batches(spark):
            out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def distance_summary(dist: DataFrame, assignments: DataFrame) -> DataFrame:
    """(source, cluster, reached, nearest, farthest, total) of path lengths by the cluster of the vertex reached."""
    labelled = dist.join(assignments, "id")
    return labelled.groupBy("source", "cluster").agg(
        F.count(F.lit(1)).alias("reached"), F.min("dist").alias("nearest"), F.max("dist").alias("farthest"), F.sum("dist").alias("total")
    )


def graph_labels(edges: DataFrame, assignments: DataFrame, default: int = 0) -> DataFrame:
    """(id, cluster) of all vertices: every labelled one, and unlabelled endpoints in ``default``."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(assignments.select("id"), "id", "left_anti").select("id", F.lit(default).alias("cluster"))
    return assignments.select("id", "cluster").unionByName(missing)


def silhouette(
    edges: DataFrame,
    assignments: DataFrame,
    samples: DataFrame,
    unreachable: str = "inf",
    default: int = 0,
    state_rows: int = STATE_ROWS,
) -> DataFrame:
    """Graph silhouette per sample: (id, cluster, a, b, coefficient).

    ``samples(id)`` are given by the caller. Vertices are all labelled ones and, in
    cluster ``default``, endpoints without a label; isolated ones count too.
    Distances are shortest paths over 1/weight. a = mean distance from the
    sample to the vertices of its own cluster, itself included at 0 (divides by
    n, not n-1); b = the smallest such mean over the other clusters;
    coefficient = (b - a) / max(a, b). Samples are taken in batches (``path_summary``).

    ``unreachable``: "inf" – a cluster with an unreached vertex has mean +inf
    (as in the source job, which then yields NaN); "drop" – means are taken
    over reached vertices only.
    """
    if unreachable not in ("inf", "drop"):
        raise ValueError(f"unknown unreachable policy {unreachable!r}")
    members = graph_labels(edges, assignments, default)
    own = samples.select("id").distinct().join(members, "id").select(F.col("id").alias("source"), F.col("cluster").alias("own"))
    sizes = cluster_sizes(members)
    per = path_summary(to_distances(edges), own.select("source"), members, state_rows).join(sizes, "cluster")
    if unreachable == "inf":
        mean = F.when(F.col("reached") < F.col("size"), F.lit(float("inf"))).otherwise(F.col("total") / F.col("size"))
    else:
        mean = F.col("total") / F.col("reached")
    per = per.select("source", "cluster", mean.alias("mean"))
    agg = own.join(per, "source").groupBy("source", "own").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))).alias("a"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean"))).alias("b"),
    )
    b = F.coalesce(F.col("b"), F.lit(float("inf"))) if unreachable == "inf" else F.col("b")
    a = F.col("a")
    top = F.greatest(a, b)
    coeff = F.when(top == 0, F.lit(float("nan"))).otherwise((b - a) / F.when(top == 0, F.lit(1.0)).otherwise(top))
    return agg.select(F.col("source").alias("id"), F.col("own").alias("cluster"), a.alias("a"), b.alias("b"),
                      coeff.alias("coefficient"))


def mean_silhouette(per_sample: DataFrame) -> DataFrame:
    """One row (silhouette, samples): the mean coefficient over the samples."""
    return per_sample.agg(F.avg("coefficient").alias("silhouette"), F.count(F.lit(1)).alias("samples"))


def hash_rank(id_col: str, draw: int) -> F.Column:
    """Deterministic pseudo-random key of an id for draw ``draw`` (md5, same in SQL)."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(draw))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def cluster_samples(assignments: DataFrame, per_cluster: int) -> DataFrame:
    """``per_cluster`` draws with replacement from each cluster: (id, cluster), distinct.

    Draw j picks the member with the smallest md5 key for j (ties: smaller
    id), by aggregations that combine before the shuffle, so a cluster holding
    a third of all vertices is never gathered into one task.
    """
    draws = [
        F.min_by(F.col("id"), F.struct(hash_rank("id", j), F.col("id"))).alias(f"d{j}") for j in range(per_cluster)
    ]
    picked = assignments.groupBy("cluster").agg(*draws)
    ids = F.explode(F.array(*[F.col(f"d{j}") for j in range(per_cluster)])).alias("id")
    return picked.select(ids, "cluster").distinct()


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def sample_members(assignments: DataFrame, fraction: float = 0.05, salt: str = "") -> DataFrame:
    """The members whose md5 key (of id and ``salt``) lies under ``fraction``: (id, cluster).

    A row's fate depends on its id alone, so the sample is alike on every layout.
    """
    return assignments.filter(md5_fraction("id", salt) < fraction)


def poisson_steps(rate: float) -> list[float]:
    """P(n <= 0), P(n <= 1), … of a Poisson number of mean ``rate``, as far as 32 bits tell them from 1."""
    steps, term, total, k = [], math.exp(-rate), 0.0, 0
    while total + term < 1.0 - 2.0**-32 and k < 1000:
        total += term
        steps.append(total)
        k += 1
        term *= rate / k
    return steps


def bootstrap_sample(assignments: DataFrame, fraction: float = 0.05, salt: str = "") -> DataFrame:
    """Sample with replacement: (id, cluster, copy); a member comes a Poisson number of times of mean ``fraction``.

    The number is the inverse of the distribution at the md5 fraction of (id, ``salt``), so it depends on the id alone and is alike
    on every layout. ``copy`` counts a member's rows from 1.
    """
    u = md5_fraction("id", salt)
    times = sum([F.when(u >= F.lit(step), 1).otherwise(0) for step in poisson_steps(fraction)], F.lit(0))
    drawn = assignments.select("id", "cluster", times.alias("_times")).filter("_times > 0")
    return drawn.select("id", "cluster", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))


def power_iteration_clusters(pairs: DataFrame, k: int, max_iter: int = 10, init_mode: str = "random") -> DataFrame:
    """Power iteration clustering of a symmetric weighted graph: (id, cluster).

    Input: each unordered pair once with a non-negative weight; self-pairs are left out. The rounds are
    ``power_iteration.embedding``'s, whose edges stay where they are (``pyspark.ml`` runs them on RDDs of objects, from a start that depends
    on the partition layout). Ends that only have pairs of weight 0 lie at 0, as all their messages do.
    """
    from shopweave.operators.power_iteration import embedding, kmeans_line

    data = stored(pairs.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).filter("src != dst"), "pairs")
    least = data.agg(F.min("weight")).first()[0]
    if least is not None and least < 0:
        raise ValueError(f"a pair has the negative weight {least}")
    values = embedding(data, max_iter, init_mode=init_mode)
    if least == 0:
        ends = data.filter("weight = 0").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        values = values.unionByName(ends.join(values, "id", "left_anti").select("id", F.lit(0.0).alias("x")))
    return kmeans_line(stored(values, "embedding"), k).select("id", F.col("cluster").cast("int"))


def label_check(assignments: DataFrame, k: int) -> DataFrame:
    """(id, labels, in_range) per vertex: how many labels it has, and whether all lie in 0..k-1."""
    return assignments.groupBy("id").agg(F.count("cluster").alias("labels"), F.min(F.col("cluster").between(0, k - 1)).alias("in_range"))
