"""Random forests grown level by level on tables, without a depth limit.

The rows of every tree (bootstrap counts from a hash of seed, tree and key) and the node each one is in are a table; so are the nodes. A level is
one aggregate to histograms per (tree, node, feature, bin), a running sum over the at most 255 bins, the best split per node, and one
join that moves the rows on. Finished nodes and the rows of the next level are written to the shared folder, so neither the driver
nor a task holds a large tree, depth is limited only by the data, and a lost executor costs at most a level. A node of at most ``ALONE`` rows is
finished by one task, with the same sums and the same rule, so the levels are about log2(rows / ALONE) and not as many as the tree is deep.

Targets are vectors of integers (fixed point): the centred value of a regressor, or the class as 0/1 entries, for which the gain

    |G_l|^2 / w_l + |G_r|^2 / w_r - |G|^2 / w

is the fall in squared error and in Gini impurity. ``min_split`` and ``min_leaf`` count rows. Null features go with the smallest values; rows without a
target are left out; an empty table gives no nodes and null predictions. Nodes are named by a hash of their path within tree and level.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .boosting import cut_points

FIXED = 2.0**30
ALONE = 1 << 18             # rows of a node that one task finishes
NODE = "tree int, node long, f int, bin short, gain double, value array<double>"
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


@dataclass
class ForestConfig:
    trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    per_node: int | None = None         # features a node draws; None: all
    bootstrap: bool = True
    seed: int = 42


def _pseudo(*parts):
    """A repeatable number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _bins(features, cuts):
    """Bin numbers of a row: 0 for null, else 1 + cut points below the value."""
    def one(f, c):
        x = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        below = F.expr(f"array({', '.join(repr(float(v)) + 'D' for v in c)})") if c else F.expr("cast(array() as array<double>)")
        return F.when(x.isNull(), 0).otherwise(F.size(F.filter(below, lambda v: v < x)) + 1).cast("short")
    return F.array(*[one(f, c) for f, c in zip(features, cuts)])


class Forest:
    """A grown forest: tables of nodes per level under ``path``."""

    def __init__(self, path: str, levels: int, features: list, cuts: list, centre: float, scale: float, classes: int, cfg: ForestConfig):
        self.path, self.levels, self.features, self.cuts = path, levels, list(features), cuts
        self.centre, self.scale, self.classes, self.cfg = centre, scale, classes, cfg

    def to_values(self) -> dict:
        return {**self.__dict__, "cfg": asdict(self.cfg)}

    @classmethod
    def from_values(cls, values: dict) -> Forest:
        return cls(**{**values, "cfg": ForestConfig(**values["cfg"])})

    def nodes(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(NODE).parquet(f"{self.path}/nodes/level={level}")

    def transform(self, df: DataFrame, key: str, out_col: str = "prediction") -> DataFrame:
        """``df`` with the mean over the trees (classifiers: the likeliest class, and ``probability`` as an array); ``key`` tells rows apart."""
        spark, done = df.sparkSession, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/forest-out-{uuid.uuid4().hex}"
        at = df.select(F.col(key).alias("__key"), _bins(self.features, self.cuts).alias("x"))       # once per row, not per tree
        at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.cfg.trees - 1))).alias("tree"), F.lit(0).cast("long").alias("node"))
        for level in range(self.levels):
            at = at.join(self.nodes(spark, level), ["tree", "node"])
            at.write.parquet(f"{done}/{level}")
            at = spark.read.parquet(f"{done}/{level}")
            at = at.where("f is not null").select("__key", "x", "tree", _child().alias("node"))
        if not self.levels:
            return df.withColumn(out_col, F.lit(None).cast("double"))
        leaves = spark.read.parquet(*[f"{done}/{level}" for level in range(self.levels)]).where("f is null")
        k = self.classes or 1
        means = leaves.groupBy("__key").agg(*[F.avg(F.col("value")[i]).alias(f"__v{i}") for i in range(k)])
        on = df[key].eqNullSafe(means["__key"])
        if not self.classes:
            return df.join(means, on, "left").withColumn(out_col, F.col("__v0") / F.lit(self.scale) + F.lit(self.centre)).drop("__key", "__v0")
        p = F.array(*[F.col(f"__v{i}") / F.lit(self.scale) for i in range(k)])
        return (df.join(means, on, "left").withColumn("probability", p)
                .withColumn(out_col, (F.array_position("probability", F.array_max("probability")) - 1).cast("double")).drop("__key", *[f"__v{i}" for i in range(k)]))

    def importances(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``: every feature's share of the gains."""
        gains = None
        for level in range(self.levels):
            part = self.nodes(spark, level).where("f is not null").groupBy("f").agg(F.sum("gain").alias("gain"))
            gains = part if gains is None else gains.unionByName(part)
        names = F.array(*[F.lit(f) for f in self.features])
        total = gains.groupBy("f").agg(F.sum("gain").alias("gain"))
        whole = F.sum("gain").over(Window.partitionBy(F.lit(0)))                 # over one row per feature
        return total.select(F.element_at(names, F.col("f") + 1).alias("feature"), (F.col("gain") / whole).alias("importance"))


def _child():
    """Name of the child that a row goes to."""
    return F.xxhash64("node", (F.element_at("x", F.col("f") + 1) <= F.col("bin")).cast("int"))


def grow(df: DataFrame, features: list[str], label: str, key: str, cfg: ForestConfig | None = None, classes: int = 0, weight: str | None = None,
         path: str | None = None) -> Forest:
    """Grow a forest on ``df``; ``classes`` 0 for a regressor. ``weight``: a row's weight (1 if none)."""
    cfg, spark = cfg or ForestConfig(), df.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    y = F.col(label).cast("double")
    df = df.where(y.isNotNull())
    cuts = cut_points(df, features)
    stat = df.agg(F.avg(y).alias("mean"), F.max(y).alias("hi"), F.min(y).alias("lo"), F.count(y).alias("n")).first()
    if classes or not stat["n"]:
        centre, scale = 0.0, FIXED
    else:
        centre = float(stat["mean"])
        spread = max(stat["hi"] - centre, centre - stat["lo"])
        scale = FIXED / spread if spread > 0 else FIXED
    if classes:
        target = F.array(*[F.when(y == c, F.lit(FIXED)).otherwise(0.0).cast("long") for c in range(classes)])
    else:
        target = F.array(F.rint((y - F.lit(centre)) * F.lit(scale)).cast("long"))
    if not stat["n"]:
        return Forest(path, 0, features, cuts, centre, scale, classes, cfg)
    cdf = F.array(*[F.lit(v) for v in _POISSON])
    draw = F.size(F.filter(cdf, lambda c: c <= F.col("u"))) if cfg.bootstrap else F.lit(1)
    rows = (df.select(F.col(key).cast("string").alias("key"), target.alias("t"), _bins(features, cuts).alias("x"),
                      (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
            .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1)))).withColumn("u", _pseudo(F.lit(cfg.seed), "tree", "key"))
            .withColumn("w", draw * F.col("weight")).where("w > 0").select("tree", F.lit(0).cast("long").alias("node"), "w", "t", "x"))
    k, level = max(classes, 1), 0
    rows = _stored(rows, f"{path}/rows/0")
    while not rows.isEmpty():
        if not cfg.per_node or cfg.per_node >= len(features):        # drawn features are drawn level by level
            large = _stored(rows.groupBy("tree", "node").count().where(F.col("count") > ALONE).select("tree", "node"), f"{path}/large/{level}")
            small = rows.join(large, ["tree", "node"], "left_anti").groupBy("tree", "node")
            small.applyInArrow(_finisher(cfg, level), f"{NODE}, level int").write.mode("append").partitionBy("level").parquet(f"{path}/nodes")
            rows = _stored(rows.join(large, ["tree", "node"], "left_semi"), f"{path}/rest/{level}")
            if rows.isEmpty():
                break
        here = _stored(_best(rows, cfg, len(features), k, level), f"{path}/best/{level}")
        here.write.mode("append").parquet(f"{path}/nodes/level={level}")
        split = here.where("f is not null").select("tree", "node", "f", "bin")
        level += 1
        rows = _stored(rows.join(split, ["tree", "node"]).select("tree", _child().alias("node"), "w", "t", "x"), f"{path}/rows/{level}")
    levels = spark.read.option("basePath", f"{path}/nodes").parquet(f"{path}/nodes").agg(F.max("level").alias("n")).first()["n"] + 1
    return Forest(path, levels, features, cuts, centre, scale, classes, cfg)


def _spark_hash(node: int, side: int) -> int:
    """``xxhash64(node, side)`` of a long and an int, as the table path names children."""
    one, two, three, four, five, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 2**64 - 1

    def turned(x, n):
        return (x << n | x >> (64 - n)) & full

    def mixed(h):
        h = (h ^ h >> 33) * two & full
        h = (h ^ h >> 29) * three & full
        return h ^ h >> 32
    h = mixed((turned((42 + five + 8 ^ turned((node & full) * two & full, 31) * one & full) & full, 27) * one + four) & full)
    h = mixed((turned((h + five + 4 & full) ^ side * one & full, 23) * two + three) & full)
    return h - 2**64 if h >= 2**63 else h


def _children(nodes: np.ndarray, side: int) -> np.ndarray:
    """``_spark_hash`` of an array of nodes."""
    one, two, three, four, five = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return h ^ (h >> np.uint64(32))
    with np.errstate(over="ignore"):
        h = mixed(turned((np.uint64(42) + five + np.uint64(8)) ^ (turned(nodes.astype(np.uint64) * two, 31) * one), 27) * one + four)
        h = mixed(turned((h + five + np.uint64(4)) ^ (np.uint64(side) * one), 23) * two + three)
    return h.astype(np.int64)


def _finisher(cfg: ForestConfig, level: int):
    def finish(key, rows):
        n = rows.num_rows
        x, t = (np.asarray(rows[c].combine_chunks().flatten()).reshape(n, -1).astype(np.int64) for c in ("x", "t"))
        return _finish(int(key[0].as_py()), int(key[1].as_py()), x, t, rows["w"].to_numpy(), cfg, level)
    return finish


def _best_of(x, t, w, rank, cfg: ForestConfig):
    """(found, feature, bin, gain) per node; ``rank`` is the node of a row, ascending from 0."""
    n, features, k = *x.shape, t.shape[1]
    bits = max(n.bit_length(), 1)
    cells = ((((rank[:, None] * features + np.arange(features)) * 256 + x) << bits) | np.arange(n)[:, None]).ravel()
    cells.sort()
    at = cells & ((1 << bits) - 1)
    cells >>= bits
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    count = np.diff(np.append(first, len(cells)))
    cells = cells[first]
    begin = np.flatnonzero(np.append(True, cells[1:] // 256 != cells[:-1] // 256))      # of the (node, feature)
    width = np.diff(np.append(begin, len(cells)))
    node = cells // (256 * features)
    ends = np.searchsorted(rank, np.arange(rank[-1] + 1))

    def sums(values, per_row):
        """Running sum over the bins of a cell's node and feature, and the node's sum."""
        run = np.cumsum(values)
        return run - np.repeat((run - values)[begin], width), np.add.reduceat(per_row, ends)[node]
    left_n, n_all = sums(count, np.ones(n, np.int64))
    left_w, w_all = sums(np.add.reduceat(w[at], first), w)
    left = here = 0.0
    right = 0.0
    for i in range(k):
        wt = w * t[:, i]
        gl, g = (v.astype(np.float64) for v in sums(np.add.reduceat(wt[at], first), wt))
        left, right, here = left + gl * gl, right + (g - gl) ** 2, here + g * g
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = left / left_w, right / (w_all - left_w)
        gain = left + right - here / w_all
        ok = (left_n >= max(cfg.min_leaf, 1)) & (n_all - left_n >= max(cfg.min_leaf, 1)) & (gain > 1e-12 * (left + right) + 1e-6)
    nodes = int(rank[-1]) + 1
    best = np.full(nodes, -np.inf)
    np.maximum.at(best, node[ok], gain[ok])
    top = np.flatnonzero(ok & (gain == best[node]))
    top = top[np.append(True, node[top][1:] != node[top][:-1])] if len(top) else top    # the first feature and bin
    f, b, found = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, bool)
    f[node[top]], b[node[top]], found[node[top]] = cells[top] // 256 % features, cells[top] % 256, True
    return found, f, b, np.where(found, best, 0.0)


def _finish(tree: int, node: int, x, t, w, cfg: ForestConfig, level: int) -> pa.Table:
    """All nodes below (and with) one small node, all nodes of a level at a time."""
    if (w == np.rint(w)).all():             # exact sums
        w = w.astype(np.int64)
    names, rank, out = np.array([node], np.int64), np.zeros(len(w), np.int64), []
    while len(names):
        begin = np.searchsorted(rank, np.arange(len(names)))            # rows lie in the order of their nodes
        total = np.add.reduceat(w, begin)
        value = np.add.reduceat(w[:, None] * t, begin, axis=0) / total[:, None]
        mixed = (np.minimum.reduceat(t, begin, axis=0) != np.maximum.reduceat(t, begin, axis=0)).any(axis=1)
        mixed &= np.diff(np.append(begin, len(w))) >= max(cfg.min_split, 2)
        if cfg.max_depth is not None and level >= cfg.max_depth:
            mixed[:] = False
        found, f, b, gain = (np.zeros(len(names), kind) for kind in (bool, np.int64, np.int64, float))
        if mixed.any():
            rows = np.flatnonzero(mixed[rank])
            x, t, w, rank = x[rows], t[rows], w[rows], (np.cumsum(mixed) - 1)[rank[rows]]
            found[mixed], f[mixed], b[mixed], gain[mixed] = here = _best_of(x, t, w, rank, cfg)
        out.append(pa.table({
            "tree": pa.array(np.full(len(names), tree, np.int32)), "node": pa.array(names), "f": pa.array(f.astype(np.int32), mask=~found),
            "bin": pa.array(b.astype(np.int16), mask=~found), "gain": pa.array(gain, mask=~found),
            "value": pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * value.shape[1]), pa.array(value.ravel())),
            "level": pa.array(np.full(len(names), level, np.int32))}))
        if not found.any():
            break
        rows = np.flatnonzero(here[0][rank])
        x, t, w, rank = x[rows], t[rows], w[rows], rank[rows]
        high = x[np.arange(len(rows)), here[1][rank]] > here[2][rank]
        to = 2 * (np.cumsum(here[0]) - 1)[rank] + high
        order = np.argsort(to, kind="stable")
        x, t, w, rank = x[order], t[order], w[order], to[order]
        names = np.column_stack([_children(names[found], 1), _children(names[found], 0)]).ravel()
        level += 1
    return pa.concat_tables(out)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best(rows: DataFrame, cfg: ForestConfig, features: int, k: int, level: int) -> DataFrame:
    """(tree, node, f, bin, gain, value): the best split of every node, ``f`` null for leaves."""
    sums = [f"g{i}" for i in range(k)]
    number = F.sequence(F.lit(0), F.lit(features - 1))
    if cfg.per_node and cfg.per_node < features:
        drawn = F.slice(F.array_sort(F.transform(number, lambda f: F.struct(F.xxhash64(F.lit(cfg.seed), F.lit(level), "tree", "node", f).alias("h"), f.alias("f")))),
                        1, cfg.per_node)
        number = F.transform(drawn, lambda s: s["f"])
    hist = (rows.select("tree", "node", "w", "t", F.explode(F.transform(number, lambda f: F.struct(f.alias("f"), F.element_at(F.col("x"), f + 1).alias("bin")))).alias("e"))
            .groupBy("tree", "node", "e.f", "e.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("t")[i]).alias(s) for i, s in enumerate(sums)]))
    side = Window.partitionBy("tree", "node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree", "node", "f")
    names = ["n", "w", *sums]
    hist = hist.select("tree", "node", "f", "bin", *[F.sum(c).over(side).alias(f"l_{c}") for c in names], *[F.sum(c).over(whole).alias(f"a_{c}") for c in names])

    def part(w, gs):
        total = sum(((g * g) for g in gs[1:]), gs[0] * gs[0])
        return F.try_divide(total, w)
    left = part(F.col("l_w"), [F.col(f"l_{s}") for s in sums])
    right = part(F.col("a_w") - F.col("l_w"), [F.col(f"a_{s}") - F.col(f"l_{s}") for s in sums])
    here = part(F.col("a_w"), [F.col(f"a_{s}") for s in sums])
    gain = left + right - here
    rest = F.col("a_n") - F.col("l_n")
    ok = (F.col("a_n") >= cfg.min_split) & (F.col("l_n") >= cfg.min_leaf) & (rest >= max(cfg.min_leaf, 1)) & (gain > F.lit(1e-12) * (left + right) + F.lit(1e-6))
    if cfg.max_depth is not None and level >= cfg.max_depth:
        ok = F.lit(False)
    hist = hist.withColumn("gain", F.when(ok, gain))
    rank = F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))
    best = hist.groupBy("tree", "node").agg(F.max(F.when(F.col("gain").isNotNull(), rank)).alias("s"), F.first("a_w").alias("w"),
                                            *[F.first(f"a_{s}").alias(s) for s in sums])
    return best.select("tree", "node", (-F.col("s.f")).alias("f"), (-F.col("s.bin")).cast("short").alias("bin"), F.col("s.gain").alias("gain"),
                       F.array(*[F.col(s) / F.col("w") for s in sums]).alias("value"))
