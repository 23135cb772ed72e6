"""Weighted user–shop graphs as two DataFrames: ``edges(src, dst, weight)`` and vertices.

Vertices are implied by edges. Recommendation graphs use kind-prefixed string
ids (``u<user>``, ``s<shop>``); similarity graphs between users keep long ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.functions.core import fold_shop, fold_user, shop_vertex, time_weight, user_vertex, vertex_kind
from shopweave.operators.skew import ROWS_PER_SALT, heavy_keys, skew_join

# Fixed event weights of the source job: a purchase counts 1, a view 0.5.
PAY_WEIGHT = 1.0
VIEW_WEIGHT = 0.5


def weighted_events(
    pay: DataFrame,
    view: DataFrame | None,
    start: str,
    as_of: str,
    mode: str = "recent",
    pay_weight: float = PAY_WEIGHT,
    view_weight: float = VIEW_WEIGHT,
    before_start: str = "drop",
) -> DataFrame:
    """Bag union of purchase and view events with their time weight: (user_id, shop_id, weight)."""
    time = time_weight("ts", start, as_of, mode, before_start)
    out = pay.select("user_id", "shop_id", (F.lit(pay_weight) * time).alias("weight"))
    if view is not None:
        v = view.select("user_id", "shop_id", (F.lit(view_weight) * time).alias("weight"))
        out = out.unionByName(v)
    return out


def sum_edges(edges: DataFrame) -> DataFrame:
    """Merge parallel edges by summing their weights; zero-weight edges are dropped."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter(F.col("weight") != 0)


def pair_weights(events: DataFrame) -> DataFrame:
    """Summed (user_id, shop_id, weight) of weighted events; zero-weight pairs are dropped."""
    return events.groupBy("user_id", "shop_id").agg(F.sum("weight").alias("weight")).filter(F.col("weight") != 0)


def _named(ids: str):
    """How users and shops are written as vertices: "name" (u7, s3), "fold" (2i, 2i + 1) or "raw" (the bare ids)."""
    if ids == "name":
        return user_vertex("user_id"), shop_vertex("shop_id")
    if ids == "fold":
        return fold_user("user_id"), fold_shop("shop_id")
    if ids == "raw":
        return F.col("user_id"), F.col("shop_id")
    raise ValueError(f"unknown vertex form {ids!r}")


def mirror(pairs: DataFrame, forward: str, backward: str, ids: str = "name") -> DataFrame:
    """Two edges of each pair, user→shop with weight ``forward`` and shop→user with ``backward``, in one pass."""
    u, s = _named(ids)
    both = F.array(
        F.struct(u.alias("src"), s.alias("dst"), F.col(forward).alias("weight")),
        F.struct(s.alias("src"), u.alias("dst"), F.col(backward).alias("weight")),
    )
    return pairs.select(F.explode(both).alias("e")).select("e.src", "e.dst", "e.weight")


def mirror_merged(merged: DataFrame) -> DataFrame:
    """Both directions (src, dst, weight, n_lists) of merged lists' pairs (user_id, shop_id, weight, n_lists).

    The pair of two nulls is its own mirror, so its directions are one edge that counts twice.
    """
    u, s = _named("name")
    alone = F.col("user_id").isNull() & F.col("shop_id").isNull()
    there, back = F.struct(u.alias("src"), s.alias("dst")), F.struct(s.alias("src"), u.alias("dst"))
    ends = F.explode(F.when(alone, F.array(there)).otherwise(F.array(there, back)))
    times = F.when(alone, 2).otherwise(1)
    return merged.select(ends.alias("e"), (F.col("weight") * times).alias("weight"), (F.col("n_lists") * times).alias("n_lists")).select("e.src", "e.dst", "weight", "n_lists")


def user_shop_edges(events: DataFrame, both_directions: bool = True, prefixed: bool = True) -> DataFrame:
    """Summed (src, dst, weight) edges from weighted events.

    Events are aggregated once on the bare ids; directions and names come last.
    ``both_directions``: user→shop and shop→user (recommendation graph);
    otherwise user→shop only (similarity input). ``prefixed``: string ids
    ``u<id>``/``s<id>``; otherwise the raw long ids.
    """
    pairs = pair_weights(events)
    ids = "name" if prefixed else "raw"
    if both_directions:
        return mirror(pairs, "weight", "weight", ids)
    u, s = _named(ids)
    return pairs.select(u.alias("src"), s.alias("dst"), "weight")


def normalize_out_weights(edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """w'(s→t) = w(s→t) / Σ_x w(s→x). Parallel edges stay separate.

    The out-sum is a partial-aggregated groupBy on ``src``; it is joined back with the
    edges of a heavy source spread over salts.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    joined = skew_join(edges.select("src", "dst", "weight"), out, "src", rows_per_salt=rows_per_salt)
    return joined.select("src", "dst", (F.col("weight") / F.col("_out")).alias("weight"))


def normalized_pairs(pairs: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(user_id, shop_id, by_user, by_shop): a pair's weight over its user's and over its shop's total.

    Pass a stored table of pairs: it is read for both totals and both joins.
    """
    heavy = heavy_keys(pairs, "shop_id", rows_per_salt)
    users = pairs.groupBy("user_id").agg(F.sum("weight").alias("_user"))
    shops = pairs.groupBy("shop_id").agg(F.sum("weight").alias("_shop"))
    first = skew_join(pairs.select("user_id", "shop_id", "weight"), users, "user_id", rows_per_salt=rows_per_salt)
    both = skew_join(first, shops, "shop_id", heavy=heavy)
    return both.select("user_id", "shop_id", (F.col("weight") / F.col("_user")).alias("by_user"), (F.col("weight") / F.col("_shop")).alias("by_shop"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def bidirectional(edges: DataFrame) -> DataFrame:
    """Bag union of an edge set with its reverse."""
    return edges.unionByName(reverse_edges(edges))


def union_edges(*edge_sets: DataFrame, merge: bool = False) -> DataFrame:
    """Bag union of several edge lists; ``merge`` sums parallel edges."""
    out = edge_sets[0]
    for e in edge_sets[1:]:
        out = out.unionByName(e)
    return sum_edges(out) if merge else out


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct vertex ids implied by the edges, with their kind for prefixed ids."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    if dict(ids.dtypes)["id"] == "string":
        ids = ids.withColumn("kind", vertex_kind("id"))
    return ids


def out_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree) for every vertex, 0 for vertices without out-edges."""
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (
        vertices(edges)
        .select("id")
        .join(deg, "id", "left")
        .select("id", F.coalesce(F.col("out_degree"), F.lit(0)).cast("long").alias("out_degree"))
    )


def user_cities(pay: DataFrame, view: DataFrame | None, shop: DataFrame) -> DataFrame:
    """Cities of the shops each user bought from or viewed: (user_id, cities sorted array)."""
    events = pay.select("user_id", "shop_id")
    if view is not None:
        events = events.unionByName(view.select("user_id", "shop_id"))
    pairs = events.distinct().join(shop.select("shop_id", "city"), "shop_id").select("user_id", "city").distinct()
    return pairs.groupBy("user_id").agg(F.array_sort(F.collect_set("city")).alias("cities"))


def city_shops(shop: DataFrame, cities: list[str] | str) -> DataFrame:
    """Shops located in one city or in a list of cities."""
    if isinstance(cities, str):
        return shop.filter(F.col("city") == cities)
    return shop.filter(F.col("city").isin(*cities))


def visited_shops(cities: DataFrame, shop: DataFrame, user_id: int) -> DataFrame:
    """(shop_id): shops in the cities one user has visited."""
    mine = cities.filter(F.col("user_id") == user_id).select(F.explode("cities").alias("city"))
    return shop.join(mine, "city", "left_semi").select("shop_id")


def seed_shops(cities: DataFrame, shop: DataFrame, user_id: int) -> DataFrame:
    """Shop vertices in the cities one user has visited."""
    return visited_shops(cities, shop, user_id).select(shop_vertex("shop_id").alias("id"))


def restrict_shops(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep edges whose endpoints both pass: user vertices always, shop vertices if in ``allowed(id)``."""
    ok = allowed.select("id").distinct()
    src_ok = ok.select(F.col("id").alias("src"), F.lit(True).alias("_src_ok"))
    dst_ok = ok.select(F.col("id").alias("dst"), F.lit(True).alias("_dst_ok"))
    e = edges.join(src_ok, "src", "left").join(dst_ok, "dst", "left")
    keep = ((vertex_kind("src") == "user") | F.col("_src_ok").isNotNull()) & (
        (vertex_kind("dst") == "user") | F.col("_dst_ok").isNotNull()
    )
    return e.filter(keep).select("src", "dst", "weight")


def city_subgraph(edges: DataFrame, cities: DataFrame, shop: DataFrame, user_id: int) -> DataFrame:
    """Subgraph of shops in the cities the user has visited (users always kept).

    The weights are not renormalised after the cut, as in the source job.
    """
    return restrict_shops(edges, seed_shops(cities, shop, user_id))
