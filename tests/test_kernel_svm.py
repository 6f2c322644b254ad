"""Kernel machine: Fourier features against the kernel, rings, calibration, coupling."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from fleetscope.operators import kernel_svm as K


def rings(spark, n=450, seed=3):
    """Three noisy rings around one centre; the test half is every second row."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1 + y + 0.35 * rng.standard_normal(n)
    rows = [(i, float(y[i]), 1.0, (i // 2) % 4, Vectors.dense(radius[i] * np.cos(angle[i]), radius[i] * np.sin(angle[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, ["id", "label", "weight", "fold", "features"])
    return df.where("id % 2 = 0"), df.where("id % 2 = 1")


def test_fourier_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    true = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    errors = []
    for dims in (64, 1024, 16_384):
        z = K.lifted(x, *K.fourier(5, 0.3, K.SvmConfig(dims=dims)))
        errors.append(np.abs(z @ z.T - true).mean())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.03 and errors[2] < 0.008


def test_coupling():
    pairs = [(0, 1), (0, 2), (1, 2)]
    p = np.array([[0.5, 0.3, 0.2], [0.9, 0.05, 0.05], [1 / 3, 1 / 3, 1 / 3]])
    r = np.column_stack([p[:, i] / (p[:, i] + p[:, j]) for i, j in pairs])          # consistent pairs give back their distribution
    assert np.allclose(K.coupled(pairs, r, 3), p, atol=1e-6)
    odd = K.coupled(pairs, np.random.default_rng(1).random((50, 3)), 3)
    assert np.allclose(odd.sum(axis=1), 1) and (odd >= 0).all()


@pytest.fixture(scope="module")
def fitted(spark):
    train, test = rings(spark)
    model, tables = K.fit(train.repartition(3), 3, 4, K.SvmConfig(dims=200, gamma=1.0, iterations=40))
    return train, test, model, tables


def test_beats_the_linear_machine_on_rings(spark, fitted):
    train, test, model, tables = fitted
    rows = model.transform(test).collect()
    share = np.mean([r.prediction == r.label for r in rows])
    linear = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01)).fit(train).transform(test).collect()
    assert share > 0.75 and share > np.mean([r.prediction == r.label for r in linear]) + 0.2
    assert sum(t.sum() for t in tables) == train.count() and sum(np.trace(t) for t in tables) / train.count() > 0.7


def test_calibrated_probabilities(spark, fitted):
    """Rows sum to 1; held-out log loss is below that of squashed margins, which is what no fit would give."""
    _, test, model, _ = fitted
    rows = model.transform(test).withColumn("p", vector_to_array("probability")).collect()
    y = np.array([int(r.label) for r in rows])
    p, m = np.array([r.p for r in rows]), np.array([r.margins for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    raw = K.coupled(model.pairs, 1 / (1 + np.exp(-m)), 3)

    def loss(q):
        return -np.log(np.clip(q[np.arange(len(y)), y], 1e-12, 1)).mean()
    assert loss(p) < loss(raw)


def test_two_classes_and_one(spark):
    df = spark.createDataFrame([(float(i % 2), 1.0, i % 3, Vectors.dense(float(i % 2) * 2 + 0.01 * i)) for i in range(30)], ["label", "weight", "fold", "features"])
    model, _ = K.fit(df, 2, 3, K.SvmConfig(dims=32, iterations=20))
    assert model.transform(df).where("prediction = label").count() == 30
    again = K.KernelSvm(**model.to_values())
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in model.transform(df).collect()]
    alone, tables = K.fit(df.where("label = 0"), 1, 3, K.SvmConfig(dims=8))
    assert tables == [] and {r.prediction for r in alone.transform(df).collect()} == {0.0}
