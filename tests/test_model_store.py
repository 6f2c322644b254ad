"""Fitted-model store: one fit per input, settings and code; half-written fits are never read."""

import tempfile

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler

from fleetscope.operators import boosting as BO
from fleetscope.sources import model_store as MS


@pytest.fixture
def place(spark):
    root = tempfile.mkdtemp(prefix="fleetscope-store-")
    spark.createDataFrame([(str(i), float(i), 2.0 * i) for i in range(30)], "key string, x double, y double").write.parquet(f"{root}/in")
    return root


def fitter(spark, root, calls):
    def fit():
        calls.append(1)
        df = spark.read.parquet(f"{root}/in")
        linear = LinearRegression(labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
        trees = BO.fit(df, ["x"], "y", BO.BoostConfig(rounds=2, max_depth=2), "key").model
        return MS.Fit({"rows": df}, {"linear": linear, "trees": trees}, {"n": df.count()})
    return fit


def test_one_fit_per_input_settings_and_code(spark, place, monkeypatch):
    store, calls = MS.ModelStore(spark, f"{place}/store"), []
    args = ("m", [f"{place}/in"], {"depth": 2}, fitter(spark, place, calls))
    first, again = store.get_or_fit(*args), store.get_or_fit(*args)
    assert len(calls) == 1 and again.values == {"n": 30} and again.frames["rows"].count() == 30
    assert again.models["trees"].trees == first.models["trees"].trees
    assert abs(again.models["linear"].coefficients[0] - 2.0) < 1e-6
    store.get_or_fit("m", [f"{place}/in"], {"depth": 3}, args[3])
    assert len(calls) == 2                                              # other settings
    spark.createDataFrame([("z", 5.0, 1.0)], "key string, x double, y double").write.mode("append").parquet(f"{place}/in")
    assert store.get_or_fit(*args).values == {"n": 31} and len(calls) == 3      # other input
    monkeypatch.setattr(MS, "code_version", lambda: "other")
    store.get_or_fit(*args)
    assert len(calls) == 4                                              # other code


def test_stale_and_half_written_fits_are_refused(spark, place, monkeypatch):
    store, calls = MS.ModelStore(spark, f"{place}/store"), []
    key = store.key([f"{place}/in"], {})
    with pytest.raises(MS.StaleModel):
        store.load("m", key)
    fit = fitter(spark, place, calls)()

    def broken(*a, **k):
        raise RuntimeError("lost before the manifest")
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", broken)
        with pytest.raises(RuntimeError):
            store.save("m", key, MS.Fit({}, {"linear": fit.models["linear"]}))
    with pytest.raises(MS.StaleModel):
        store.load("m", key)
    store.save("m", key, fit)
    assert store.load("m", key).values == {"n": 30}
    with pytest.raises(MS.StaleModel):
        store.load("m", "another key")
