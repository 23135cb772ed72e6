"""Column-level helpers. Everything here returns a JVM-side ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vertex ids: users and shops share one integer id space in the data, so graph
# vertices carry their kind in the id. Results name vertices by prefix (u7, s3);
# loops use folded longs (user 2i, shop 2i + 1), which join and shuffle cheaper.
USER_PREFIX = "u"
SHOP_PREFIX = "s"


def user_vertex(col: str | Column) -> Column:
    return F.concat(F.lit(USER_PREFIX), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def shop_vertex(col: str | Column) -> Column:
    return F.concat(F.lit(SHOP_PREFIX), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def vertex_kind(id_col: str | Column) -> Column:
    """Kind of a named vertex (u7, s3)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(c.startswith(SHOP_PREFIX), F.lit("shop")).otherwise(F.lit("user"))


def fold_user(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long") * 2


def fold_shop(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long") * 2 + 1


def folded_kind(id_col: str | Column) -> Column:
    """Kind of a folded vertex id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(F.pmod(c, F.lit(2)) == 1, F.lit("shop")).otherwise(F.lit("user"))


def folded_name(id_col: str | Column) -> Column:
    """Name (u7, s3) of a folded vertex id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    number = F.floor(c / 2).cast("string")
    return F.when(F.pmod(c, F.lit(2)) == 1, F.concat(F.lit(SHOP_PREFIX), number)).otherwise(F.concat(F.lit(USER_PREFIX), number))


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) value, independent of the session time zone."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return (
        F.unix_date(F.to_date(c)).cast("long") * 86400
        + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    )


def time_weight(ts: str | Column, start: str, as_of: str, mode: str = "recent", before_start: str = "drop") -> Column:
    """Linear time weight of an event.

    ``recent``: 1 - age/span clipped to [0, 1] (newer events weigh more).
    ``age``:    1 + age/span, the formula as the source job evaluates it
                (older events weigh more, from 1 to 2).
    age = as_of - ts and span = as_of - start, both in whole seconds.

    ``before_start``, for ``recent``: an event before ``start`` weighs 0, so edges
    built from such events alone are dropped ("drop"), or fails the job ("error").
    """
    if before_start not in ("drop", "error"):
        raise ValueError(f"unknown before_start {before_start!r}")
    as_of_s = epoch_seconds(F.lit(as_of))
    age = (as_of_s - epoch_seconds(ts)).cast("double")
    span = (as_of_s - epoch_seconds(F.lit(start))).cast("double")
    if mode == "recent":
        weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - age / span))
        if before_start == "error":
            return F.when(age > span, F.raise_error(F.lit(f"an event lies before {start}")).cast("double")).otherwise(weight)
        return weight
    if mode == "age":
        return F.lit(1.0) + age / span
    raise ValueError(f"unknown time-weight mode {mode!r}")


def round_half_up(col: str | Column, places: int) -> Column:
    """floor(x·10^p + 0.5) / 10^p: plain IEEE operations, so SQL engines agree bit for bit.

    (``round`` differs between engines on exact binary halves such as 21/1024.)
    Infinities, NaN and values too large to have such places pass unchanged.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    scale = float(10**places)
    plain = F.isnan(c) | (F.abs(c) >= F.lit(2.0**52 / scale))
    return F.when(plain, c).otherwise(F.floor(F.when(plain, F.lit(0.0)).otherwise(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def round9(col: str | Column) -> Column:
    """Doubles of magnitude about 1 are compared at 9 places: plain sums differ in the last bits."""
    return round_half_up(col, 9)


def round6(col: str | Column) -> Column:
    """Large doubles (path lengths, sums over many edges) are compared at 6 places."""
    return round_half_up(col, 6)


def md5_bucket(cols: list[str], buckets: int = 100, salt: str = "") -> Column:
    """Deterministic bucket in [0, buckets) of a row key, independent of partitioning; another ``salt``, another draw."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], *([F.lit(salt)] if salt else []))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def md5_fraction(col: str, salt: str = "") -> Column:
    """Deterministic pseudo-random number in [0, 1) of an id (md5, same in SQL)."""
    h = F.md5(F.concat_ws("|", F.col(col).cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
