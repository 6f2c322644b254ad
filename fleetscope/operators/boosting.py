"""Gradient-boosted trees from feature histograms.

One engine grows the trees of a round together: the K trees of a softmax model, and those of every cross-validation fold beside the final
fit (a fold is a *run* that leaves its rows out). The feature matrix is stored once as blocks of bin numbers with the running
margins of every run. A pass over the blocks sums count, gradient and hessian per (tree, node, feature, bin) inside each partition, adds
the sums up per node by a shuffle, finds the best split of a node where its sums arrive, and returns one row per node.
The driver holds the trees of a round (bounded by the settings, not by the rows), never rows or histograms.

* Depth-wise growth takes one pass per level. Leaf-wise growth expands the best leaves a pass ahead and then replays the
  best-first order on the known gains, so a tree of 31 leaves takes about as many passes as it is deep, and is exactly the best-first tree.
* The runs of a table of at most ``ALONE`` full blocks are grown side by side, a task per run, without a job per pass. The trees are the same.
* Gradients are summed as integers (fixed point), so a model does not depend on partitioning, task order or lost executors.
* Nulls and NaN are a bin of their own and go to the side with the larger gain.
* Margins are carried in the blocks from round to round; a reliable checkpoint every ``CHECKPOINT_ROUNDS`` rounds cuts the lineage.

The passes use ``mapPartitions`` on blocks: 1,000 and more passes of array arithmetic over the same stored blocks, with a sparse sum as shuffle value.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BINS = 256                  # bin 0: null; 1..255 by the cut points
BLOCK_ROWS = 32_768         # sums of 2^32-scaled gradients over a block stay exact in a double
PART_ROWS = 16_384          # least rows of a partition of blocks
ALONE = 16                  # full blocks of a table whose runs are grown by one task each, as one block (sums stay exact up to 64)
CHECKPOINT_ROUNDS = 10
FIXED = 2.0**32
BLOCK = "keys binary, y binary, fold binary, bins binary"


@dataclass
class BoostConfig:
    objective: str = "squared"          # "squared" | "softmax"
    rounds: int = 100
    rate: float = 0.1
    max_depth: int | None = None
    max_leaves: int | None = None       # set: leaf-wise growth
    min_leaf: int = 1                   # least rows of a leaf
    min_hessian: float = 0.0            # least hessian sum of a leaf
    l2: float = 0.0
    second_order: bool = False          # gain from hessian sums instead of counts
    subsample: float = 1.0              # share of the rows that a round draws, by a hash of the key
    stop_after: int | None = None       # rounds without a better validation loss (tables above stop_rows only)
    stop_rows: int = 10_000
    validation: float = 0.1
    seed: int = 42


@dataclass
class Tree:
    """Nodes in creation order; ``feature`` -1 marks a leaf. A row goes left if its bin is at most ``bin`` (null: ``null_left``)."""
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    null_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        """A new leaf; returns its number."""
        for values, v in ((self.feature, -1), (self.bin, 0), (self.null_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            values.append(v)
        return len(self.feature) - 1

    def arrays(self):
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.null_left, bool),
                np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value))


def leaf_of(tree: tuple, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Leaf number of every row; ``at``: nodes that the rows are known to reach (changed in place)."""
    feature, cut, null_left, left, right, _ = tree
    at = np.zeros(len(bins), np.int32) if at is None else at
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        node = at[live]
        b = bins[live, feature[node]]
        at[live] = np.where(np.where(b == 0, null_left[node], b <= cut[node]), left[node], right[node])
        live = live[feature[at[live]] >= 0]
    return at


def cut_points(df: DataFrame, features: list[str]) -> list[list[float]]:
    """At most 254 cut points per feature, from one pass with a bounded sketch (exact up to 10,000 rows)."""
    probs = ", ".join(f"{i / (BINS - 1):.12f}" for i in range(1, BINS - 1))
    x = [f"CASE WHEN NOT isnan(CAST(`{f}` AS DOUBLE)) THEN CAST(`{f}` AS DOUBLE) END" for f in features]
    row = df.agg(*[F.expr(f"percentile_approx({c}, array({probs}), 10000)") for c in x], *[F.expr(f"max({c})") for c in x]).first()
    return [[v for v in sorted(set(row[i] or [])) if v < row[len(features) + i]] for i in range(len(features))]


def binned(values: np.ndarray, cuts: list) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(values[:, f]), 0, np.searchsorted(np.array(c), values[:, f]) + 1)
    return out


def _unit(keys: np.ndarray, *parts: int) -> np.ndarray:
    """A repeatable number in [0, 1) per key."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.uint64(p + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


class _Task:
    """What a pass needs to know besides the trees."""

    def __init__(self, cfg: BoostConfig, classes: int, runs: int, folds: int, n_features: int, scale: float, validate: bool, only: int | None = None):
        self.cfg, self.classes, self.folds, self.n_features = cfg, classes, folds, n_features
        self.scale, self.validate = scale, validate
        self.runs = range(runs) if only is None else [only]         # their margins and trees lie in this order
        self.trees = len(self.runs) * classes

    def held_out(self, block, run):
        """Rows that a run is judged on (none for a final fit without early stopping)."""
        if run < self.folds:
            return block["fold"] == run
        return block["draw"] < self.cfg.validation if self.validate else np.zeros(len(block["y"]), bool)

    def gradients(self, block, at):
        """Negative gradient and hessian per row and tree of the run in place ``at``."""
        margin = block["margin"][:, at * self.classes:(at + 1) * self.classes]
        if self.cfg.objective == "squared":
            return block["y"][:, None] - margin, np.ones_like(margin)
        p = softmax(margin)
        return (block["y"][:, None] == np.arange(self.classes)) - p, p * (1 - p)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _summed(index, sums):
    """Rows of equal index added up; sorted by index."""
    if (index[1:] > index[:-1]).all():
        return index, sums
    order = np.argsort(index, kind="stable")
    index, sums = index[order], sums[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.empty(0, np.int64)
    return index[first], np.add.reduceat(sums, first, axis=0) if len(index) else sums


def _drawn(block, task, place, run, round_no):
    """Rows that a run draws, and the fixed-point gradient and hessian of its trees; the passes of a round in one task share them."""
    memo, cfg = block["memo"], task.cfg
    if (round_no, run) not in memo:
        use = ~task.held_out(block, run)
        if cfg.subsample < 1:
            use &= _unit(block["keys"], cfg.seed, 2, round_no, run) < cfg.subsample
        g, h = task.gradients(block, place)
        memo[round_no, run] = use, np.rint(g * task.scale), np.rint(h * FIXED)
    return memo[round_no, run]


def _block_sums(block, task, trees, frontier, offset, round_no):
    """(index of (slot, feature, bin), [count, gradient, hessian]) of one block, all trees."""
    bins, cfg, out_i, out_s = block["bins"], task.cfg, [], []
    n, features = bins.shape
    for place, run in enumerate(task.runs):
        wanted = [k for k in range(task.classes) if frontier[place * task.classes + k]]
        if not wanted:
            continue
        use, g, h = _drawn(block, task, place, run, round_no)
        for k in wanted:
            t = place * task.classes + k
            slot_of = np.full(len(trees[t][0]), -1)
            slot_of[frontier[t]] = offset[t] + np.arange(len(frontier[t]))
            known = block["memo"].setdefault((round_no, "leaf", t), np.zeros(n, np.int32))
            slot = slot_of[leaf_of(trees[t], bins, known)]
            rows = np.flatnonzero(use & (slot >= 0))
            if not len(rows):
                continue
            lowest = slot[rows].min()
            flat = (((slot[rows] - lowest)[:, None] * features + np.arange(features)) * BINS + bins[rows]).ravel()
            gi, hi = np.repeat(g[rows, k], features), np.repeat(h[rows, k], features)
            width = int(slot[rows].max() - lowest + 1) * features * BINS
            if width <= 8 * len(flat):
                count = np.bincount(flat, minlength=width)
                at = np.flatnonzero(count)
                sums = np.stack([count[at], np.bincount(flat, gi, width)[at], np.bincount(flat, hi, width)[at]], axis=1)
            else:
                at, back = np.unique(flat, return_inverse=True)
                sums = np.stack([np.bincount(back), np.bincount(back, gi), np.bincount(back, hi)], axis=1)
            out_i.append(at + int(lowest) * features * BINS)
            out_s.append(sums.astype(np.int64))
    return out_i, out_s


def best_splits(index, sums, task: _Task) -> np.ndarray:
    """One row per slot: slot, gain, feature, bin, null left, (count, gradient, hessian) of the node and of its left child.

    Of equal gains the first feature, bin and side is taken. ``index`` is sorted."""
    cfg, features = task.cfg, task.n_features
    seg, bin_ = index // BINS, index % BINS
    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(index) else np.empty(0, np.int64)
    seg_no = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(index))))
    seg = seg[first]
    slot = seg // features
    slots, where = np.unique(slot, return_index=True)
    no_null = bin_[first] > 0                               # the bin of nulls comes first
    unit = (1.0, task.scale, FIXED)
    columns = [np.ascontiguousarray(sums[:, i]) for i in range(3)]
    total = [np.add.reduceat(c, first) if len(first) else c for c in columns]
    null = [np.where(no_null, 0, c[first]) for c in columns]
    run = []
    for c, t, n in zip(columns, total, null):               # of the bins present, inside the segment
        sofar = np.cumsum(c)
        run.append(sofar - (sofar[first] - c[first] + n)[seg_no])
    a, d = [t / u for t, u in zip(total, unit)], 2 if cfg.second_order else 0
    with np.errstate(divide="ignore", invalid="ignore"):
        here = a[1] ** 2 / (a[d] + cfg.l2)
    out = np.zeros((len(slots), 11))
    out[:, 0], out[:, 1], out[:, 5:8] = slots, -np.inf, np.column_stack(total)[where]
    least = max(cfg.min_leaf, 1)
    for null_left in (False, True) if null[0].any() else (False,):
        shift = null[0] if null_left else np.zeros(len(first), np.int64)
        count = run[0] + shift[seg_no]
        ok = (bin_ > 0) & (count >= least) & (total[0][seg_no] - count >= least)
        if null_left:
            ok &= null[0][seg_no] > 0
        at = np.flatnonzero(ok)
        s = seg_no[at]
        left = [c[at] + n[s] if null_left else c[at] for c, n in zip(run, null)]
        l = [v / u for v, u in zip(left, unit)]
        r = [(t[s] - v) / u for t, v, u in zip(total, left, unit)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = l[1] ** 2 / (l[d] + cfg.l2) + r[1] ** 2 / (r[d] + cfg.l2) - here[s]
        keep = np.flatnonzero(np.isfinite(gain) & (l[2] >= cfg.min_hessian) & (r[2] >= cfg.min_hessian))
        if not len(keep):
            continue
        gain, of = gain[keep], slot[s[keep]]
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(begin, len(of)))
        top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, begin), size))
        top = top[np.append(True, of[top][1:] != of[top][:-1])]
        k = keep[top]
        gain, to, f, b = gain[top], np.searchsorted(slots, of[top]), seg[s[k]] % features, bin_[at[k]]
        side = np.where(null[0][s[k]] > 0, null_left, left[0][k] >= total[0][s[k]] - left[0][k])       # no nulls seen: the larger side
        if null_left:                                       # a tie stays with the first way
            was = out[to]
            better = (gain > was[:, 1]) | ((gain == was[:, 1]) & ((f < was[:, 2]) | ((f == was[:, 2]) & (b < was[:, 3]))))
        else:
            better = np.ones(len(to), bool)
        rows = np.column_stack([gain, f, b, side])
        out[to[better], 1:5] = rows[better]
        out[to[better], 8:11] = np.column_stack([v[k] for v in left])[better]
    return out


class BoostedTrees:
    """A fitted model: bin cuts, base margins, trees by round and class."""

    def __init__(self, cfg: BoostConfig, features: list[str], cuts: list, base: list[float], trees: list[list[Tree]]):
        self.cfg, self.features, self.cuts, self.base, self.trees = cfg, list(features), cuts, list(base), trees

    @property
    def featureImportances(self) -> np.ndarray:
        """Share of every feature in the gains of all splits."""
        out = np.zeros(len(self.features))
        for tree in (t for r in self.trees for t in r):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out / out.sum() if out.sum() > 0 else out

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Margins (rows x classes) of a matrix with NaN for null."""
        bins = binned(values, self.cuts)
        out = np.tile(np.array(self.base), (len(values), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                a = tree.arrays()
                out[:, k] += a[5][leaf_of(a, bins)]
        return out

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        """``df`` with ``out_col``; classifiers also add ``probability``. The features are columns, or a vector column ``features``."""
        model, names = self, self.features

        def run(x):
            values = np.array([[np.nan if v is None else v for v in row] for row in x], np.float64).reshape(len(x), len(names))
            margin = model.margins(values)
            return pd.Series(list(softmax(margin) if model.cfg.objective == "softmax" else margin))
        run.__annotations__ = {"x": pd.Series, "return": pd.Series}
        if all(f in df.columns for f in names):
            x = F.array(*[F.col(f).cast("double") for f in names])
        else:
            from pyspark.ml.functions import vector_to_array
            x = vector_to_array(F.col("features"))
        out = df.withColumn("__p", F.pandas_udf(run, "array<double>")(x))
        if self.cfg.objective != "softmax":
            return out.withColumn(out_col, F.col("__p")[0]).drop("__p")
        from pyspark.ml.functions import array_to_vector
        return (out.withColumn(out_col, (F.array_position("__p", F.array_max("__p")) - 1).cast("double"))
                .withColumn("probability", array_to_vector("__p")).drop("__p"))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per tree, and one (round -1) with the rest."""
        meta = json.dumps({"cfg": asdict(self.cfg), "features": self.features, "cuts": self.cuts, "base": self.base})
        rows = [(-1, 0, meta)] + [(r, k, json.dumps(asdict(t))) for r, trees in enumerate(self.trees) for k, t in enumerate(trees)]
        spark.createDataFrame(rows, "round int, cls int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["round"], r["cls"]))
        meta, trees = json.loads(rows[0]["body"]), {}
        for r in rows[1:]:
            trees.setdefault(r["round"], []).append(Tree(**json.loads(r["body"])))
        return cls(BoostConfig(**meta["cfg"]), meta["features"], meta["cuts"], meta["base"], [trees[r] for r in sorted(trees)])


@dataclass
class BoostResult:
    model: BoostedTrees
    runs: list                  # a model per fold
    held_out: list              # per fold: matrix of counts (true class x predicted class), classifiers only


def _pack(df: DataFrame, features, label, key, fold, cuts) -> DataFrame:
    """Blocks of rows, formed inside the partitions."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                values = np.column_stack([c.astype(np.float64) for c in columns[3:]]) if len(columns) > 3 else np.empty((part.num_rows, 0))
                row = [columns[0].astype(np.int64).tobytes(), columns[1].astype(np.float64).tobytes(), columns[2].astype(np.int32).tobytes(),
                       binned(values, cuts).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["keys", "y", "fold", "bins"])

    fold = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    return (df.where(F.col(label).isNotNull())
            .select(F.xxhash64(F.col(key).cast("string")).alias("k"), F.col(label).cast("double").alias("y"), fold.alias("f"),
                    *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).mapInArrow(run, BLOCK))


def fit(df: DataFrame, features: list[str], label: str, cfg: BoostConfig, key: str, fold: str | None = None, folds: int = 0,
        classes: int = 1) -> BoostResult:
    """Fit the final model and, with ``folds``, one model per fold on the other folds' rows (all grown together).

    ``label`` is the class number 0.. for softmax, else the value. Rows without a label are left out. A table without rows, or with one
    class only, gives a model without trees.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    classes = classes if cfg.objective == "softmax" else 1
    cuts = cut_points(df.where(F.col(label).isNotNull()), features)
    y = F.col(label).cast("double")
    stat = df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    n, runs = stat["n"], folds + 1
    if not n:
        return BoostResult(BoostedTrees(cfg, features, cuts, [0.0] * classes, []), [], [])
    validate = bool(cfg.stop_after) and n > cfg.stop_rows
    if cfg.objective == "softmax":
        counts = df.where(y.isNotNull()).groupBy(y.cast("int").alias("c"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("f")).count().collect()
        bases = [_priors(counts, run if run < folds else None, classes) for run in range(runs)]
        scale = FIXED
    else:
        bases = [[float(stat["mean"])]] * runs
        spread = max(abs(stat["hi"] - stat["mean"]), abs(stat["lo"] - stat["mean"]))
        scale = 2.0**31 / spread if spread > 0 else 1.0
    task = _Task(cfg, classes, runs, folds, len(features), scale, validate)
    start = np.concatenate(bases)

    def block(row):
        keys, target = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["y"])
        return {"keys": keys, "y": target, "fold": np.frombuffer(row["fold"], np.int32), "draw": _unit(keys, cfg.seed, 1),
                "bins": np.frombuffer(row["bins"], np.uint8).reshape(len(keys), -1), "margin": np.tile(start, (len(keys), 1)), "memo": {}}

    parts = 1 if n <= ALONE * BLOCK_ROWS else max(1, min(-(-n // PART_ROWS), 4 * spark.sparkContext.defaultParallelism))
    packed = _pack(df.coalesce(parts), features, label, key, fold, cuts)
    fixed = n * classes == 0 or (cfg.objective == "squared" and stat["hi"] == stat["lo"])
    if parts == 1:
        def run_alone(run, rows):
            one = _Task(cfg, classes, runs, folds, len(features), scale, validate, run)
            blocks = [block(r) for r in rows]
            whole = {c: np.concatenate([b[c] for b in blocks]) for c in ("keys", "y", "fold", "draw", "bins")}
            whole.update(margin=np.tile(bases[run], (len(whole["y"]), 1)), memo={})
            return [(run, *_alone(whole, one, 0 if fixed else cfg.rounds))]
        done = (packed.rdd.flatMap(lambda row: [(run, row) for run in range(runs)]).partitionBy(runs, int)
                .mapPartitionsWithIndex(lambda run, rows: run_alone(run, [row for _, row in rows])).collect())
        models = [BoostedTrees(cfg, features, cuts, bases[run], trees) for run, trees, _ in done]
        return BoostResult(models[-1], models[:-1], [table for _, _, table in done[:folds]] if cfg.objective == "softmax" else [])
    data = packed.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
    grown, rounds, former = [[] for _ in range(runs)], 0, None
    early = _EarlyStop(cfg)
    while rounds < cfg.rounds and not fixed:
        trees = _round(data, task, rounds, parts)
        for run in range(runs):
            grown[run].append(trees[run * classes:(run + 1) * classes])
        rounds += 1
        data, former = _moved(data, former, [t.arrays() for t in trees], rounds), data
        if validate:
            if early.now(data.map(lambda b: _loss(b, task)).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))):
                break
    held = []
    if folds and cfg.objective == "softmax":
        table = data.map(lambda b: np.stack([_confusion(b, task, f, f) for f in range(folds)])).reduce(lambda a, b: a + b)
        held = list(table)
    for rdd in (data, former):
        if rdd is not None:
            rdd.unpersist()
    models = [BoostedTrees(cfg, features, cuts, bases[run], grown[run]) for run in range(runs)]
    return BoostResult(models[-1], models[:-1], held)


def _priors(counts, run, classes):
    n = np.zeros(classes)
    for r in counts:
        if r["f"] is None or r["f"] != run:
            n[r["c"]] += r["count"]
    p = np.clip(n / max(n.sum(), 1), np.finfo(np.float32).eps, 1 - np.finfo(np.float32).eps)
    return np.log(p).tolist()


def _loss(block, task):
    held = task.held_out(block, task.runs[-1])
    e = block["y"][held] - block["margin"][held, -1]
    return float((e * e).sum()) / 2, int(held.sum())


def _confusion(block, task, f, place):
    """Counts (true class x predicted class) of the rows of a fold by the run in a place."""
    out = np.zeros((task.classes, task.classes), np.int64)
    rows = np.flatnonzero(block["fold"] == f)
    guess = block["margin"][rows, place * task.classes:(place + 1) * task.classes].argmax(axis=1)
    np.add.at(out, (block["y"][rows].astype(np.int64), guess), 1)
    return out


class _EarlyStop:
    """Whether ``stop_after`` rounds went by without a better validation loss."""

    def __init__(self, cfg: BoostConfig):
        self.after, self.best, self.since = cfg.stop_after, math.inf, 0

    def now(self, loss) -> bool:
        loss = loss[0] / max(loss[1], 1)
        if loss < self.best - 1e-7:
            self.best, self.since = loss, 0
        else:
            self.since += 1
        return self.since >= self.after


def _alone(block, task, rounds):
    """All rounds of one run on the rows of a small table: (trees by round, counts of the held-out rows)."""
    run, grown, early = task.runs[0], [], _EarlyStop(task.cfg)
    for round_no in range(rounds):
        def find(arrays, frontier, offset, round_no=round_no):
            found = _sums([block], task, arrays, frontier, offset, round_no)
            return [best_splits(*found, task)] if found else []
        grown.append(_grow(find, task))
        block = _moved_block(block, [t.arrays() for t in grown[-1]])
        if task.validate and run == task.folds and early.now(_loss(block, task)):
            break
    return grown, _confusion(block, task, run, 0) if task.cfg.objective == "softmax" else None


def _moved_block(b, trees):
    """The block with the margins after a round."""
    margin = b["margin"].copy()
    for t, tree in enumerate(trees):
        if len(tree[0]) > 1 or tree[5][0] != 0:
            margin[:, t] += tree[5][leaf_of(tree, b["bins"])]
    return {**b, "margin": margin, "memo": {}}


def _moved(data, former, trees, round_no):
    """The blocks with the margins after a round. ``former``, which ``data`` was made from, is released; a lost block comes again from the last checkpoint."""
    after = data.map(lambda b: _moved_block(b, trees)).persist(StorageLevel.MEMORY_AND_DISK)
    if round_no % CHECKPOINT_ROUNDS == 0:
        after.checkpoint()
        after.count()
    if former is not None:
        former.unpersist()
    return after


def _sums(blocks, task, arrays, frontier, offset, round_no):
    """The sums of a partition's blocks."""
    parts = [_block_sums(b, task, arrays, frontier, offset, round_no) for b in blocks]
    index, sums = [x for i, _ in parts for x in i], [x for _, s in parts for x in s]
    return _summed(np.concatenate(index), np.concatenate(sums)) if index else None


def _round(data, task: _Task, round_no: int, parts: int) -> list[Tree]:
    """The trees of one round, a job per pass."""
    def find(arrays, frontier, offset):
        def split(blocks):
            found = _sums(blocks, task, arrays, frontier, offset, round_no)
            if found:
                index, sums = found
                part = index // (task.n_features * BINS) % parts
                for p in np.unique(part).tolist():
                    yield p, (index[part == p], sums[part == p])

        def merged(a, b):
            return _summed(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        return (data.mapPartitions(split).reduceByKey(merged, parts, partitionFunc=int)
                .map(lambda kv: best_splits(*kv[1], task)).collect())

    return _grow(find, task)


def _grow(find, task: _Task) -> list[Tree]:
    """Trees grown from ``find(trees, frontier, first slot of every tree)``, the best splits of the frontier's nodes."""
    cfg = task.cfg
    trees = [Tree() for _ in range(task.trees)]
    known = [{} for _ in trees]                 # node -> (slot, gain, feature, bin, null left, sums, sums of the left child)
    depth = [{0: 0} for _ in trees]
    frontier = [[0] for _ in trees]
    while any(frontier):
        offset = np.concatenate([[0], np.cumsum([len(f) for f in frontier])])
        found = find([t.arrays() for t in trees], frontier, offset)
        for row in (r for a in found for r in a):
            t = int(np.searchsorted(offset, row[0], side="right")) - 1
            known[t][frontier[t][int(row[0] - offset[t])]] = row
        for t, nodes in enumerate(frontier):    # a node without rows of the draw has no row
            for node in nodes:
                known[t].setdefault(node, np.array([0, -np.inf, 0, 0, 0, *np.zeros(6)]))
        frontier = [_expand(trees[t], known[t], depth[t], cfg) for t in range(len(trees))]
    return [_finished(trees[t], known[t], task) for t in range(len(trees))]


def _splittable(row):
    return row[1] > 1e-12 * max(row[5], 1)


def _chosen(tree, known, cfg):
    """Nodes split, and leaves left, by the growth order as far as the gains are known; and whether a leaf must be expanded to go on."""
    if cfg.max_leaves is None:                  # depth-wise: whatever can be split is
        leaves = [x for x, f in enumerate(tree.feature) if f < 0]
        return [x for x, f in enumerate(tree.feature) if f >= 0], leaves, any(_splittable(known[x]) for x in leaves)
    leaves, split = [0], []
    while len(leaves) < cfg.max_leaves:
        open_ = [x for x in leaves if _splittable(known[x])]
        if not open_:
            break
        node = max(open_, key=lambda x: (known[x][1], -x))
        if tree.feature[node] < 0:
            return split, leaves, True
        split.append(node)
        leaves.remove(node)
        leaves += [tree.left[node], tree.right[node]]
    return split, leaves, False


def _expand(tree, known, depth, cfg):
    """Split the leaves that growth may take next; returns the children whose sums are needed."""
    _, leaves, more = _chosen(tree, known, cfg)
    if not more:
        return []
    open_ = [x for x in leaves if tree.feature[x] < 0 and _splittable(known[x])]
    if cfg.max_leaves is not None:
        open_ = sorted(open_, key=lambda x: (-known[x][1], x))[:cfg.max_leaves - len(leaves)]
    wanted = []
    for x in open_:
        row = known[x]
        tree.feature[x], tree.bin[x], tree.null_left[x], tree.gain[x] = int(row[2]), int(row[3]), bool(row[4]), float(row[1])
        for side, part in (("left", row[8:11]), ("right", row[5:8] - row[8:11])):
            child = tree.add()
            getattr(tree, side)[x] = child
            depth[child] = depth[x] + 1
            if part[0] >= 2 * max(cfg.min_leaf, 1) and (cfg.max_depth is None or depth[child] < cfg.max_depth):
                wanted.append(child)
            else:
                known[child] = np.array([0, -np.inf, 0, 0, 0, *part, 0, 0, 0])
    return wanted or _expand(tree, known, depth, cfg)


def _finished(tree, known, task):
    """The tree with only the splits that were taken, and its leaf values."""
    cfg, out = task.cfg, Tree()
    split = set(_chosen(tree, known, cfg)[0])

    def value(node):
        row = known[node]
        g, h = row[6] / task.scale, row[7] / FIXED
        if cfg.objective == "softmax":
            k = task.classes
            return cfg.rate * (k - 1) / k * g / h if h > 1e-150 else 0.0
        return cfg.rate * g / (h + cfg.l2) if h + cfg.l2 > 0 else 0.0

    todo = [(0, 0)]
    while todo:
        node, at = todo.pop()
        if node not in split:
            out.value[at] = value(node)
            continue
        out.feature[at], out.bin[at], out.null_left[at], out.gain[at] = tree.feature[node], tree.bin[node], tree.null_left[node], tree.gain[node]
        for side in ("left", "right"):
            child = out.add()
            getattr(out, side)[at] = child
            todo.append((getattr(tree, side)[node], child))
    return out


def weighted_f1(table: np.ndarray) -> float:
    """Support-weighted F1 of a matrix of counts (true x predicted)."""
    hit, true, guessed = np.diag(table), table.sum(axis=1), table.sum(axis=0)
    f1 = np.where(true + guessed > 0, 2 * hit / np.maximum(true + guessed, 1), 0.0)
    return float((f1 * true).sum() / max(true.sum(), 1))
