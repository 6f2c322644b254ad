"""Pure column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DEFAULT_SPEEDS, EARTH_RADIUS_M, ROAD_CATEGORIES, UNDEFINED_CATEGORY


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D"
    return str(v)


def literal_map(mapping: dict) -> Column:
    """A constant MAP column; lookups stay inside the generated code.

    Built from one SQL expression (one round trip) rather than a literal per entry.
    """
    return F.expr(_map_sql(mapping))


def epoch_seconds(ts) -> Column:
    """Seconds since epoch of a TIMESTAMP_NTZ (or TIMESTAMP) column, as double.

    Works on wall-clock values, so it does not depend on the session time zone.
    """
    c = col_(ts)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz")) / F.lit(1e6)


def _sql(c) -> str | None:
    """SQL text of a plain column name, else None (then Column builders are used)."""
    return f"`{c}`" if isinstance(c, str) else None


def time_band(hour) -> Column:
    """[6,8) alba, [8,18) giorno, [18,22) sera, otherwise notte."""
    h = _sql(hour)
    if h:
        return F.expr(f"CASE WHEN {h} >= 6 AND {h} < 8 THEN 'alba' WHEN {h} >= 8 AND {h} < 18 THEN 'giorno' "
                      f"WHEN {h} >= 18 AND {h} < 22 THEN 'sera' ELSE 'notte' END")
    h = col_(hour)
    return (F.when((h >= 6) & (h < 8), "alba")
            .when((h >= 8) & (h < 18), "giorno")
            .when((h >= 18) & (h < 22), "sera")
            .otherwise("notte"))


def session_type(duration_min) -> Column:
    """< 30 min breve, <= 120 min normale, otherwise lunga."""
    d = _sql(duration_min)
    if d:
        return F.expr(f"CASE WHEN {d} < 30 THEN 'breve' WHEN {d} <= 120 THEN 'normale' ELSE 'lunga' END")
    d = col_(duration_min)
    return F.when(d < 30, "breve").when(d <= 120, "normale").otherwise("lunga")


def _map_sql(mapping: dict) -> str:
    return "map(" + ", ".join(f"{_sql_literal(k)}, {_sql_literal(v)}" for k, v in mapping.items()) + ")"


def road_category(road_type) -> Column:
    """Road category; missing, 'unclassified' or unlisted types are 'undefined'."""
    r = _sql(road_type)
    if r:
        return F.expr(f"coalesce(try_element_at({_map_sql(ROAD_CATEGORIES)}, {r}), '{UNDEFINED_CATEGORY}')")
    return F.coalesce(F.try_element_at(literal_map(ROAD_CATEGORIES), col_(road_type)),
                      F.lit(UNDEFINED_CATEGORY))


def default_speed(highway) -> Column:
    return F.try_element_at(literal_map(DEFAULT_SPEEDS), col_(highway))


def speed_limit(maxspeed, highway) -> Column:
    """First run of digits of ``maxspeed`` as int; else default of ``highway``; else -1.

    Units are ignored ("60 mph" -> 60), "none" falls back to the default.
    """
    digits = F.regexp_extract(F.coalesce(col_(maxspeed), F.lit("")), r"(\d+)", 1)
    parsed = F.when(digits != "", digits).try_cast("int")
    return F.coalesce(parsed, default_speed(highway), F.lit(-1)).cast("int")


def web_mercator_x(lon) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(col_(lon))


def web_mercator_y(lat) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(col_(lat)) / 2))


def finite_or(c, default=0.0) -> Column:
    """NaN, +-inf and NULL become ``default``."""
    x = col_(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(x)


def safe_div(num, den, default=0.0) -> Column:
    """Division that yields ``default`` for a zero/missing denominator or non-finite result."""
    n, d = col_(num).cast("double"), col_(den).cast("double")
    return F.when(d.isNull() | (d == 0) | n.isNull(), F.lit(default)).otherwise(finite_or(F.try_divide(n, d), default))


def numeric_or_zero(c) -> Column:
    """Bad or missing numeric value becomes 0 (and is still counted)."""
    return F.coalesce(col_(c).try_cast("double"), F.lit(0.0))


def stable_hash_key(seed, key) -> Column:
    """Repeatable pseudo-random order key: md5 of ``seed|key`` (same text in SQL)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), col_(key).cast("string")))
