"""Mutual information between continuous features and a class by nearest neighbours (M8).

For a row with class c (n_c rows) and k' = min(k, n_c - 1): r is its distance to the k'-th nearest row of its class, m the number of
rows of any class nearer than r, itself included. A feature's information is

    psi(n) + mean(psi(k')) - mean(psi(n_c)) - mean(psi(m)),   at least 0,

with psi the digamma function; rows of a class of one row are left out. Each feature is one dimension, so nothing is joined in
pairs. Neighbours: the rows of a class are ranked by value and cut into rank blocks; a block also gets the ``k`` rows beyond each of its ends, and
lags and leads inside the block give the distances. Counts: the bounds x - r and x + r are merged into the sorted values
and a running count is read at both. Ranks and running counts go by value pieces with a carry, so no task holds a feature or a class.

Values become integers on a grid of 2^-50 of the feature's largest magnitude with a jitter of +-2^15 steps from the row's key: ties are
broken in a repeatable way and distances are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum

GRID = 2.0**50
PIECES = 256
BLOCK = 65_536               # ranks of a block
EULER = 0.57721566490153286061


def digamma(n):
    """psi of a column of positive integers: harmonic sums up to 16, then the asymptotic series (error below 1e-13)."""
    small, total = [], -EULER
    for i in range(1, 17):
        small.append(total)
        total += 1.0 / i
    x = n.cast("double")
    y = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - y * (F.lit(1 / 12) - y * (F.lit(1 / 120) - y * (F.lit(1 / 252) - y / 240)))
    return F.when(n <= 16, F.element_at(F.array(*[F.lit(v) for v in small]), F.least(n, F.lit(16)).cast("int"))).otherwise(series)


def gridded(df: DataFrame, features: list[str], label: str, key: str, seed: int) -> DataFrame:
    """(key, feature, label, v): non-null values on the integer grid, jittered; classes of one row left out."""
    args = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    rows = (df.where(F.col(label).isNotNull()).selectExpr(f"CAST(`{key}` AS STRING) AS key", f"`{label}` AS label", f"stack({len(features)}, {args}) AS (feature, x)")
            .where("x is not null and not isnan(x)"))
    top = rows.groupBy("feature").agg(F.max(F.abs("x")).alias("top"))
    rows = rows.join(F.broadcast(top), "feature")                     # one row per feature
    noise = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", "key")), 1, 4), 16, 10).cast("long") - 32768
    on_grid = F.when(F.col("top") > 0, F.floor(F.col("x") / F.col("top") * F.lit(GRID)).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("key", "feature", "label", (on_grid + noise).alias("v"))
    sizes = rows.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n_c"))
    return rows.join(sizes.where("n_c > 1"), ["feature", "label"])


def mutual_info_knn(df: DataFrame, features: list[str], label: str, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``feature, mutual_info`` (nats). Features without rows are missing; keys should tell rows apart (equal keys get equal jitter)."""
    from ..session import materialize
    rows = materialize(gridded(df, features, label, key, seed))
    cuts = ", ".join(str(i / PIECES) for i in range(1, PIECES))
    edges = F.broadcast(rows.groupBy("feature").agg(F.expr(f"array_distinct(percentile_approx(v, array({cuts}), 10000))").alias("edges")))   # PIECES longs per feature

    def pieced(df, column):
        return df.join(edges, "feature").withColumn("piece", F.size(F.filter("edges", lambda e: e < F.col(column)))).drop("edges")

    ranked = running_sum(pieced(rows, "v"), ["feature", "label"], ["v", "key"], {"rank": F.lit(1)}, chunk="piece")
    at, in_block = F.floor((F.col("rank") - 1) / BLOCK).cast("long"), (F.col("rank") - 1) % BLOCK
    homes = F.array(at, F.when(in_block < k, at - 1), F.when(in_block >= BLOCK - k, at + 1))
    blocks = ranked.withColumn("home", at).withColumn("block", F.explode(F.filter(homes, lambda b: b.isNotNull() & (b >= 0))))
    w = Window.partitionBy("feature", "label", "block").orderBy("v", "key")
    gaps = [F.col("v") - F.lag("v", i).over(w) for i in range(1, k + 1)] + [F.lead("v", i).over(w) - F.col("v") for i in range(1, k + 1)]
    near = (blocks.withColumn("gaps", F.array(*gaps)).where("block = home")
            .withColumn("k", F.least(F.lit(k), F.col("n_c") - 1))
            .withColumn("r", F.element_at(F.sort_array(F.filter("gaps", lambda g: g.isNotNull())), F.col("k").cast("int"))))
    near = materialize(near.select("feature", "key", "label", "v", "n_c", "k", F.greatest(F.col("r") - 1, F.lit(0)).alias("reach")))
    side = F.explode(F.array(F.struct((F.col("v") - F.col("reach")).alias("at"), F.lit(0).alias("turn")), F.struct(F.col("v").alias("at"), F.lit(1).alias("turn")),
                             F.struct((F.col("v") + F.col("reach")).alias("at"), F.lit(2).alias("turn")))).alias("e")
    events = near.select("feature", "key", "label", "n_c", "k", side).select("feature", "key", "label", "n_c", "k", "e.*")
    counted = running_sum(pieced(events, "at"), ["feature"], ["at", "turn", "key"], {"below": (F.col("turn") == 1).cast("int")}, chunk="piece")
    part = F.when(F.col("turn") == 2, F.col("below")).when(F.col("turn") == 0, -F.col("below")).otherwise(0)
    m = counted.groupBy("feature", "label", "key").agg(F.sum(part).alias("m"), F.first("n_c").alias("n_c"), F.first("k").alias("k"))
    info = m.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("k"))).alias("a"), F.avg(digamma(F.col("n_c"))).alias("b"),
                                    F.avg(digamma(F.col("m"))).alias("c"))
    return info.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("c")).alias("mutual_info"))
