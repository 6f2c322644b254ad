"""Query registry: name -> (Spark plan over the given tables, independent SQL).

Every Spark callable takes ``(spark, sf_dir)``, reads the whole given tables
and returns a lazy DataFrame. Double columns are rounded to ``PLACES`` on both
sides so engines that sum in a different order compare equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 6
# Values are compared after rounding half-even at PLACES decimals. Results such
# as 16.5/64 sit exactly on a rounding tie and two engines may land one ulp to
# either side of it; adding 1e-9 (away from zero) moves every tie off the
# simple decimals the data produces. Used only for the comparison columns.
NUDGE = 1e-9


@dataclass
class QuerySpec:
    name: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None                   # None -> rows-only check (models, randomness)
    doubles: list[str] = field(default_factory=list)
    places: dict[str, int] = field(default_factory=dict)


_REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | None = None,
             places: dict[str, int] | None = None):
    def deco(fn):
        _REGISTRY[name] = QuerySpec(name, fn, sql, list(doubles or []), dict(places or {}))
        return fn
    return deco


def round_doubles(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    places = places or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            p = places.get(f.name, PLACES)
            x = F.col(f.name)
            cols.append((F.bround(x + F.signum(x) * F.lit(NUDGE), p) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded_sql(spec: QuerySpec) -> str | None:
    if spec.sql is None:
        return None
    if not spec.doubles:
        return spec.sql
    repl = ", ".join(f"(round_even({c} + sign({c}) * {NUDGE}, {spec.places.get(c, PLACES)}) + 0.0) AS {c}"
                     for c in spec.doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{spec.sql}\n) AS q"


def _load_all():
    # importing the query modules fills the registry
    from . import queries  # noqa: F401


def all_specs() -> dict[str, QuerySpec]:
    _load_all()
    return dict(_REGISTRY)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, spec in all_specs().items():
        def run(spark, sf_dir, _spec=spec):
            return round_doubles(_spec.spark(spark, sf_dir), _spec.places)
        out[name] = run
    return out


def oracle_sql() -> dict[str, str]:
    return {n: rounded_sql(s) for n, s in all_specs().items() if s.sql is not None}
