"""Joins whose large side may have very frequent keys.

Keys with more rows than ``rows_per_salt`` (and more than a ten-thousandth of all
rows, so there are at most ``MAX_HEAVY_KEYS`` of them) are heavy. A heavy key's rows are
spread over as many salts as it needs, and the small side's row is repeated for each;
other keys have one salt and are joined as they are. The table of heavy keys has a
proven size, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HEAVY_KEYS = 10_000
ROWS_PER_SALT = 1_000_000


def heavy_keys(large: DataFrame, on: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(on, _salts): the heavy keys of ``large`` with their number of salts; null is not counted."""
    counts = large.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = large.select(F.count(F.lit(1))).scalar()
    limit = F.greatest(F.lit(float(rows_per_salt)), total / F.lit(float(MAX_HEAVY_KEYS)))
    return counts.withColumn("_limit", limit).filter("_n > _limit").select(on, F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_salts"))


def salted(large: DataFrame, heavy: DataFrame, on: str, by: list[str]) -> DataFrame:
    """``large`` with ``_salt``: rows of a heavy key are spread by the hash of ``by``."""
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    marked = large.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    return marked.drop("_salts")


def fanned(small: DataFrame, heavy: DataFrame, on: str) -> DataFrame:
    """``small`` with ``_salt``: a heavy key's rows once per salt."""
    top = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    return small.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), top))).drop("_salts")


def skew_join(
    large: DataFrame, small: DataFrame, on: str, how: str = "inner", rows_per_salt: int = ROWS_PER_SALT, heavy: DataFrame | None = None
) -> DataFrame:
    """Join of ``large`` to ``small`` (``how``: inner, left or left_semi) with heavy keys of ``large`` spread.

    ``large`` is read several times, so pass a stored table, or ``heavy`` found from one
    when ``large`` is itself derived by joins.
    """
    if heavy is None:
        heavy = heavy_keys(large, on, rows_per_salt)
    by = [c for c in large.columns if c != on] or [on]
    return salted(large, heavy, on, by).join(fanned(small, heavy, on), [on, "_salt"], how).drop("_salt")
