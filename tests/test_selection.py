"""Nearest-neighbour mutual information against all pairs; exact imputation and scaling against numpy."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import knn_information as KI
from fleetscope.operators import preparation as PR


def psi(n):
    return sum(1.0 / i for i in range(1, n)) - KI.EULER


def all_pairs(rows, k=3, seed=42):
    """rows: (key, label, x) of one feature ``x``."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[2])]
    top = max(abs(r[2]) for r in rows)
    grid = [(key, c, (math.floor(x / top * KI.GRID) if top else 0) + int(hashlib.md5(f"{seed}|x|{key}".encode()).hexdigest()[:4], 16) - 32768)
            for key, c, x in rows]
    sizes = Counter(c for _, c, _ in grid)
    grid = [g for g in grid if sizes[g[1]] > 1]
    a = b = m = 0.0
    for i, (_, c, v) in enumerate(grid):
        kk = min(k, sizes[c] - 1)
        r = sorted(abs(v - w) for j, (_, d, w) in enumerate(grid) if d == c and j != i)[kk - 1]
        a, b, m = a + psi(kk), b + psi(sizes[c]), m + psi(sum(abs(v - w) <= max(r - 1, 0) for _, _, w in grid))
    n = len(grid)
    return max(0.0, psi(n) + (a - b - m) / n)


def data(kind, n=300):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, n)
    x = {"informative": label + 0.3 * rng.standard_normal(n), "noise": rng.standard_normal(n), "ties": np.round(label + rng.standard_normal(n)),
         "zeros": np.zeros(n), "skew": np.exp(5 * rng.standard_normal(n) + label)}[kind]
    return [(f"k{i}", int(label[i]), float(x[i])) for i in range(n)]


@pytest.mark.parametrize("kind", ["informative", "noise", "ties", "zeros", "skew"])
@pytest.mark.parametrize("block", [8, 65_536])
def test_equals_all_pairs(spark, monkeypatch, kind, block):
    monkeypatch.setattr(KI, "BLOCK", block)
    rows = data(kind) + [("lone", 9, 1.0), ("none", 1, None), ("nan", 1, float("nan")), ("unlabelled", None, 2.0)]
    df = spark.createDataFrame(rows, "key string, label int, x double").repartition(5)
    got = {r.feature: r.mutual_info for r in KI.mutual_info_knn(df, ["x"], "label", "key").collect()}
    assert abs(got["x"] - all_pairs(rows)) < 1e-9


def test_informative_beats_noise_and_small_classes(spark):
    rows = [(k, c, x, y) for (k, c, x), (_, _, y) in zip(data("informative"), data("noise"))]
    df = spark.createDataFrame(rows, "key string, label int, x double, y double")
    got = {r.feature: r.mutual_info for r in KI.mutual_info_knn(df, ["x", "y"], "label", "key").collect()}
    assert got["x"] > 0.4 > 0.1 > got["y"] >= 0
    pair = [("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, 5.0), ("d", 1, 6.0), ("e", 1, 7.5)]
    df = spark.createDataFrame(pair, "key string, label int, x double")
    assert abs(KI.mutual_info_knn(df, ["x"], "label", "key").first().mutual_info - all_pairs(pair)) < 1e-9
    assert KI.mutual_info_knn(df.limit(0), ["x"], "label", "key").count() == 0


def test_digamma(spark):
    rows = spark.range(1, 3000).select("id", KI.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-11 for r in rows)


def test_imputation_and_scaling_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((501, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] = 4.0
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] + [None] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    prep = PR.fit_preparation(df, ["a", "b", "c", "d"])
    done = prep.transform(df, ["a", "b", "c", "d"]).collect()
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    low, mid, high = np.percentile(filled, [25, 50, 75], axis=0)
    want = (filled - mid) / np.where(high > low, high - low, 1.0)
    got = np.array(sorted(tuple(r.features) for r in done))
    assert np.allclose(got, np.array(sorted(map(tuple, np.column_stack([want, np.zeros(501)])))))
    assert all(r._i_d == 0.0 for r in done) and PR.feature_quantiles(df.limit(0), ["a"], {"m": 0.5}).count() == 0
