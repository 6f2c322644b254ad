"""Exact quantiles (linear interpolation) without a buffer that grows with a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = 256
SMALL_GROUP = 65_536        # values of a key that one aggregation buffer may hold


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float], small_group: int = SMALL_GROUP) -> DataFrame:
    """One row per key: a column per entry of ``probs``, as ``percentile(x, p)`` gives (nulls ignored).

    Keys are counted first. Those of at most ``small_group`` values are one ``percentile`` aggregate, whose buffer is bounded
    by that count; the others go the way of ``_ranked_quantiles``. Both ways give the same values. ``df`` is read once
    more than there are ways, so callers pass a stored table.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    key = keys or ["__key"]
    if not keys:
        rows = rows.withColumn("__key", F.lit(0))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__size"))
    largest = sizes.agg(F.max("__size")).first()[0] or 0           # one number

    def direct(part: DataFrame) -> DataFrame:
        return part.dropna(subset=key).groupBy(*key).agg(*[F.percentile("__x", F.lit(p)).alias(name) for name, p in probs.items()]).select(*keys, *probs)

    if largest <= small_group:
        return direct(rows)
    if not keys:
        return _ranked_quantiles(rows.drop("__key"), keys, "__x", probs)
    known = rows.join(sizes, key)                                   # rows without a key are left out, here and by ranks
    large = _ranked_quantiles(known.where(F.col("__size") > small_group), keys, "__x", probs)
    return direct(known.where(F.col("__size") <= small_group)).unionByName(large)


def _ranked_quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` of keys with any number of values.

    A bounded sketch per key (``approx_percentile``) cuts the key's value range into at most ``PIECES`` pieces of about
    equal size. Counts per piece say which pieces hold the wanted ranks; only their values are ranked, each
    piece on its own, so neither a large key nor the whole table is ever in one task.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    if not keys:
        rows = rows.withColumn("__key", F.lit(0))
    key = keys or ["__key"]
    cuts = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    edges = rows.groupBy(*key).agg(F.approx_percentile("__x", cuts, 10_000).alias("__e"), F.count("__x").alias("__n"))
    edges = edges.withColumn("__e", F.array_distinct("__e"))
    low, high = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("__n") - 1)
        low.append((name, F.floor(at).cast("long"), at - F.floor(at)))
        high.append(F.ceil(at).cast("long"))
    cut = edges.select(*key, "__e")
    counted = (rows.join(cut if keys else F.broadcast(cut), key)           # without keys: one row
               .withColumn("__piece", F.size(F.filter("__e", lambda e: e < F.col("__x"))))
               .groupBy(*key, "__piece", "__x").agg(F.count(F.lit(1)).alias("__c")))
    sizes = counted.groupBy(*key, "__piece").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("__from", F.coalesce(F.sum("__s").over(before), F.lit(0)))      # at most PIECES rows per key
             .join(edges.select(*key, "__n"), key))
    wanted = None
    for r in [*[x[1] for x in low], *high]:
        hit = (r >= F.col("__from")) & (r < F.col("__from") + F.col("__s"))
        wanted = hit if wanted is None else wanted | hit
    inside = Window.partitionBy(*key, "__piece").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counted.join(sizes.where(wanted).select(*key, "__piece", "__from", "__n"), [*key, "__piece"])
              .withColumn("__to", F.col("__from") + F.sum("__c").over(inside)))

    def value(rank):
        return F.max(F.when((rank < F.col("__to")) & (rank >= F.col("__to") - F.col("__c")), F.col("__x")))
    out = ranked.groupBy(*key).agg(
        *[value(r).alias(f"__l{i}") for i, (_, r, _) in enumerate(low)], *[value(r).alias(f"__h{i}") for i, r in enumerate(high)],
        F.first("__n").alias("__n"))
    return out.select(*keys, *[((1 - part) * F.col(f"__l{i}") + part * F.col(f"__h{i}")).alias(name)
                               for i, (name, _, part) in enumerate(low)])
