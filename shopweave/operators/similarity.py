"""User–user similarity through each shop's heaviest user (hub).

For a normalised user→shop edge (u→s, w) whose shop has hub h with weight m,
two edges are emitted, (u, h, w·m) and (h, u, w·m), and self pairs (u = h) are
dropped. Edges from different shops are not summed: the result is a bag of
star edges around hub users, never all pairs within a shop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.operators import graph as G
from shopweave.operators.skew import ROWS_PER_SALT, skew_join
from shopweave.session import discard, stored


def shop_hubs(user_shop: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Heaviest user per shop: (shop_id, hub, hub_weight); ties go to the smaller user id.

    Two hash aggregations that combine on the map side: the largest weight of a shop,
    then the smallest user that has it.
    """
    edges = user_shop.select(F.col("src").alias("hub"), F.col("dst").alias("shop_id"), "weight")
    top = edges.groupBy("shop_id").agg(F.max("weight").alias("hub_weight"))
    best = skew_join(edges, top, "shop_id", rows_per_salt=rows_per_salt).filter("weight = hub_weight")
    return best.groupBy("shop_id").agg(F.min("hub").alias("hub"), F.max("hub_weight").alias("hub_weight"))


def hub_similarity(user_shop: DataFrame, hubs: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Similarity edges (src, dst, weight, via_shop) around hub users, both directions.

    A popular shop's edges are spread over salts for the join with its hub.
    """
    if hubs is None:
        hubs = shop_hubs(user_shop, rows_per_salt)
    edges = user_shop.select(F.col("src").alias("user"), F.col("dst").alias("shop_id"), "weight")
    e = skew_join(edges, hubs, "shop_id", rows_per_salt=rows_per_salt).filter("user != hub")
    w = F.col("weight") * F.col("hub_weight")
    both = F.array(
        F.struct(F.col("user").alias("src"), F.col("hub").alias("dst"), w.alias("weight")),
        F.struct(F.col("hub").alias("src"), F.col("user").alias("dst"), w.alias("weight")),
    )
    return e.select(F.explode(both).alias("e"), F.col("shop_id").alias("via_shop")).select("e.src", "e.dst", "e.weight", "via_shop")


def similarity_graph(
    pay: DataFrame,
    view: DataFrame | None,
    shop: DataFrame,
    start: str,
    as_of: str,
    city: str | list[str] | None = None,
    mode: str = "recent",
) -> DataFrame:
    """Logs → (city filter) → time weights → user→shop sums → normalise → hub similarity."""
    if city is not None:
        shops = G.city_shops(shop, city).select("shop_id")
        pay = pay.join(shops, "shop_id", "left_semi")
        view = view.join(shops, "shop_id", "left_semi") if view is not None else None
    return hub_similarity(normalized_user_shop(pay, view, start, as_of, mode))


def normalized_user_shop(pay: DataFrame, view: DataFrame | None, start: str, as_of: str, mode: str = "recent") -> DataFrame:
    """User→shop edges on the bare ids, normalised per user; stored, as hubs, clusters and joins all read them."""
    edges = stored(G.user_shop_edges(G.weighted_events(pay, view, start, as_of, mode), both_directions=False, prefixed=False), "pairs")
    shares = stored(G.normalize_out_weights(edges), "user-shop")
    discard(edges)
    return shares


def symmetric_pairs(sim: DataFrame) -> DataFrame:
    """Each unordered pair once (src < dst) with the summed weight of all its edges."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    return sim.groupBy(lo.alias("src"), hi.alias("dst")).agg(F.sum("weight").alias("weight"))
