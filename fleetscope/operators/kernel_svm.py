"""Support vector machine with the Gaussian kernel and calibrated probabilities.

Random Fourier features drawn from a seed turn the kernel exp(-gamma |x - y|^2) into an inner product of ``dims`` cosines, so a linear hinge fit (Spark's
``LinearSVC``) on them is a kernel machine whose cost grows with the rows and not with their square. One machine per pair of
classes, and one per pair and fold that has not seen the fold's rows.

Probabilities: a sigmoid is fitted to the out-of-fold margins of every pair (targets (n+ + 1)/(n+ + 2) and 1/(n- + 2), as rows of
fractional weight), and the pairs' probabilities are coupled to one distribution over the classes: the p that minimises the sum over
pairs of (r_ji p_i - r_ij p_j)^2 with sum 1, from one linear system per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


@dataclass
class SvmConfig:
    c: float = 1.0
    dims: int = 512
    gamma: float | None = None          # None: 1 / (features * variance of all feature values)
    iterations: int = 50
    parallelism: int = 6
    seed: int = 42


def fourier(features: int, gamma: float, cfg: SvmConfig):
    """Directions and phases of the random features."""
    rng = np.random.default_rng(cfg.seed)
    return rng.standard_normal((features, cfg.dims)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, cfg.dims)


def lifted(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def coupled(pairs: list, r: np.ndarray, classes: int) -> np.ndarray:
    """Class probabilities (rows x classes) from ``r``: column k is the probability of the first class of pair k."""
    n = len(r)
    q = np.zeros((n, classes, classes))
    for k, (i, j) in enumerate(pairs):
        a = np.clip(r[:, k], 1e-7, 1 - 1e-7)
        q[:, i, i] += (1 - a) ** 2
        q[:, j, j] += a ** 2
        q[:, i, j] = q[:, j, i] = -a * (1 - a)
    system = np.zeros((n, classes + 1, classes + 1))
    system[:, :classes, :classes], system[:, classes, :classes], system[:, :classes, classes] = q, 1, 1
    right = np.zeros((n, classes + 1, 1))
    right[:, classes] = 1
    p = np.clip(np.linalg.solve(system, right)[:, :classes, 0], 0, None)
    return p / p.sum(axis=1, keepdims=True)


class KernelSvm:
    """A fitted machine. ``transform`` adds ``probability`` (vector), ``margins`` and ``prediction`` to rows with a vector ``features``."""

    def __init__(self, directions, phases, pairs, weights, sigmoids, classes):
        self.directions, self.phases, self.pairs, self.classes = np.asarray(directions), np.asarray(phases), [tuple(p) for p in pairs], classes
        self.weights = [(np.asarray(w), float(b)) for w, b in weights]       # per pair; a positive margin is for the first class
        self.sigmoids = [tuple(s) for s in sigmoids]

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = lifted(x, self.directions, self.phases)
        return np.column_stack([z @ w + b for w, b in self.weights]) if self.pairs else np.zeros((len(x), 0))

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        if self.classes == 1:
            return np.ones((len(margins), 1))
        r = np.column_stack([1 / (1 + np.exp(-np.clip(a * margins[:, k] + b, -700, 700))) for k, (a, b) in enumerate(self.sigmoids)])
        return coupled(self.pairs, r, self.classes)

    def votes(self, margins: np.ndarray) -> np.ndarray:
        """Class with the most won pairs (ties: the lower class)."""
        won = np.zeros((len(margins), self.classes))
        for k, (i, j) in enumerate(self.pairs):
            won[:, i] += margins[:, k] > 0
            won[:, j] += margins[:, k] <= 0
        return won.argmax(axis=1)

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        def run(x):
            m = model.margins(np.array(x.tolist(), np.float64).reshape(len(x), -1))
            p = model.probabilities(m)
            return pd.DataFrame({"margins": list(m), "p": list(p), "vote": model.votes(m).astype(float)})
        run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
        out = df.withColumn("__svm", F.pandas_udf(run, "margins array<double>, p array<double>, vote double")(vector_to_array("features")))
        return (out.withColumn("margins", F.col("__svm.margins")).withColumn("probability", array_to_vector("__svm.p"))
                .withColumn("prediction", F.col("__svm.vote")).drop("__svm"))

    def to_values(self) -> dict:
        return {"directions": self.directions.tolist(), "phases": self.phases.tolist(), "pairs": self.pairs, "classes": self.classes,
                "weights": [(w.tolist(), b) for w, b in self.weights], "sigmoids": self.sigmoids}


def fit(train: DataFrame, classes: int, folds: int, cfg: SvmConfig | None = None) -> tuple[KernelSvm, list]:
    """Fit on rows (``features`` vector, ``label`` 0.., ``weight``, ``fold``); also returns a matrix of counts (true x voted) per fold."""
    cfg = cfg or SvmConfig()
    x = vector_to_array("features")
    stats = train.select(F.explode(x).alias("v"), F.size(x).alias("d")).agg(F.var_pop("v").alias("var"), F.max("d").alias("d")).first()
    width = stats["d"] or 0
    gamma = cfg.gamma or (1.0 / (width * stats["var"]) if width and stats["var"] else 1.0)
    directions, phases = fourier(width, gamma, cfg)

    def lift(v):
        return pd.Series(list(lifted(np.array(v.tolist(), np.float64).reshape(len(v), -1), directions, phases)))
    lift.__annotations__ = {"v": pd.Series, "return": pd.Series}
    rows = materialize(train.select("label", "weight", "fold", array_to_vector(F.pandas_udf(lift, "array<double>")(x)).alias("z")))
    sizes = {(r["label"], r["fold"]): r["count"] for r in rows.groupBy("label", "fold").count().collect()}
    present = sorted({int(k[0]) for k in sizes})
    pairs = list(combinations(present, 2))

    def one(job):
        (i, j), fold = job
        part = rows.where(F.col("label").isin(i, j))
        n = sum(c for (lab, f), c in sizes.items() if lab in (i, j) and f != fold)
        if fold is not None:
            part = part.where(F.col("fold") != fold)
        part = part.withColumn("target", (F.col("label") == i).cast("double"))
        model = LinearSVC(featuresCol="z", labelCol="target", weightCol="weight", regParam=1.0 / (cfg.c * max(n, 1)), maxIter=cfg.iterations,
                          standardization=False).fit(part)
        return model.coefficients.toArray(), float(model.intercept)

    jobs = [(p, f) for p in pairs for f in [None, *range(folds)]]
    with ThreadPool(max(1, cfg.parallelism)) as pool:
        fitted = dict(zip([(p, f) for p, f in jobs], pool.map(one, jobs)))
    blank = [(0.0, 0.0)] * len(pairs)
    final = KernelSvm(directions, phases, pairs, [fitted[p, None] for p in pairs], blank, classes)
    held = [KernelSvm(directions, phases, pairs, [fitted[p, f] for p in pairs], blank, classes) for f in range(folds)]

    def judge(z, fold):                 # margins of the machines that have not seen the row's fold
        z, fold = np.array(z.tolist(), np.float64).reshape(len(z), -1), fold.to_numpy()
        out, vote = np.zeros((len(z), len(pairs))), np.zeros(len(z))
        for f, model in enumerate(held):
            at = fold == f
            out[at] = np.column_stack([z[at] @ w + b for w, b in model.weights])
            vote[at] = model.votes(out[at])
        return pd.DataFrame({"m": list(out), "vote": vote})
    judge.__annotations__ = {"z": pd.Series, "fold": pd.Series, "return": pd.DataFrame}
    if not pairs or not folds:
        return final, []
    unseen = materialize(rows.select("label", "fold", F.pandas_udf(judge, "m array<double>, vote double")(vector_to_array("z"), "fold").alias("j"))
                         .select("label", "fold", "j.*"))
    final.sigmoids = [_sigmoid(unseen, k, i, j) for k, (i, j) in enumerate(pairs)]
    tables = [np.zeros((classes, classes), np.int64) for _ in range(folds)]
    for r in unseen.groupBy("fold", "label", "vote").count().collect():          # folds x classes x classes
        tables[int(r["fold"])][int(r["label"]), int(r["vote"])] += r["count"]
    return final, tables


def _sigmoid(unseen: DataFrame, k: int, i: int, j: int) -> tuple[float, float]:
    """Slope and offset of the probability of class ``i`` against ``j`` given the margin."""
    part = unseen.where(F.col("label").isin(i, j)).select((F.col("label") == i).alias("hit"), F.col("m")[k].alias("m"))
    n = {r["hit"]: r["count"] for r in part.groupBy("hit").count().collect()}
    target = F.when(F.col("hit"), (n.get(True, 0) + 1.0) / (n.get(True, 0) + 2.0)).otherwise(1.0 / (n.get(False, 0) + 2.0))
    soft = part.select("m", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))).alias("t"))
    soft = soft.select(array_to_vector(F.array("m")).alias("x"), "t.y", "t.w")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0).fit(soft)
    return float(model.coefficients[0]), float(model.intercept)
