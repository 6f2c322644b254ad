"""Model code paths: selection methods, boosting / SVM one-vs-rest, saving a pipeline."""

import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from conftest import SF0001
from fleetscope.plans import ml as ML
from fleetscope.plans.session_features import session_features_from_raw
from fleetscope.sources.telemetry import load_telemetry, with_parsed_timestamp


@pytest.fixture(scope="module")
def sessions(spark):
    return session_features_from_raw(load_telemetry(spark, "/root/testdata/sf0.01"))


def test_selection_methods(spark, sessions):
    feats = list(ML.SESSION_FEATURES)
    for method, k in (("anova", 5), ("mutual_info", 5), ("rfe", 24)):
        cfg = ML.StyleConfig(selection=method, k_features=k)
        chosen = ML.select_features(sessions.withColumnRenamed("stile_guida", "label"), feats, "label", cfg)
        assert len(chosen) == k and set(chosen) <= set(feats), method


def test_boosting_and_svm_paths(spark, sessions):
    cfg = ML.StyleConfig(gb_rounds=2, gb_depth=2, cv_folds=2, k_features=5, selection="anova")
    res = ML.train_style_models(sessions, models=("Gradient Boosting",), cfg=cfg)
    scores = ML.style_model_scores(res).collect()
    assert [r["model"] for r in scores] == ["Gradient Boosting"] and 0.0 <= scores[0]["test_f1"] <= 1.0
    imp = ML.feature_importance(res.models["Gradient Boosting"], res.selected)
    assert len(imp) == 5 and abs(sum(v for _, v in imp) - 1.0) < 1e-6
    probability_checks(res, "Gradient Boosting")
    ranked = ML.style_importances(res).collect()
    assert len(ranked) == 5 and all(r["model"] == "Gradient Boosting" and r["best"] for r in ranked)
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True)
    svm = ML._classifier("SVM", cfg, 100)            # one-vs-rest linear SVM, a single fit
    svm.getClassifier().setMaxIter(5)
    res.models["SVM"] = svm.fit(res.train)
    assert ML.style_predictions(res, "SVM").count() == res.test.count()
    probability_checks(res, "SVM")


def probability_checks(res, name):
    """Per test session: one row per class, probabilities in [0, 1] that sum to 1."""
    per = {}
    for r in ML.style_probabilities(res, name).collect():
        per.setdefault(r["session_key"], []).append(r)
    assert len(per) == res.test.count()
    for rows in per.values():
        assert sorted(str(r["cls"]) for r in rows) == sorted(res.labels)
        assert all(0.0 <= r["probability"] <= 1.0 for r in rows)
        assert abs(sum(r["probability"] for r in rows) - 1.0) < 1e-9
        top = max(r["probability"] for r in rows)
        assert any(r["cls"] == r["prediction"] and r["probability"] >= top - 1e-9 for r in rows)


def test_forest_and_logistic_reports(spark, sessions):
    cfg = ML.StyleConfig(rf_trees=5, rf_depth=4, cv_folds=2, k_features=5, selection="anova", lr_iter=20)
    res = ML.train_style_models(sessions, models=("Random Forest", "Logistic Regression"), cfg=cfg)
    for name in res.models:
        probability_checks(res, name)
    ranked = ML.style_importances(res).collect()           # also there when the linear model is chosen
    assert {r["model"] for r in ranked} == {"Random Forest"} and len(ranked) == 5
    assert {r["best"] for r in ranked} == {res.best_name == "Random Forest"}


def test_fuel_regressors_and_saved_best(spark):
    """y = 3 a - 2 b + 1 exactly: least squares wins and is the model saved; forest depth is a parameter."""
    rows = [(i, float(i % 17), float(i % 5), 3.0 * (i % 17) - 2.0 * (i % 5) + 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, fuel_delta_smooth double")
    metrics, fitted = ML.train_fuel_models(df, features=("a", "b"), models=("Random Forest", "Linear Regression"), forest_depth=3)
    r2 = {r["name"]: r["r2"] for r in metrics.collect()}
    assert r2["Linear Regression"] > 1 - 1e-9 and 0.3 < r2["Random Forest"] < 1
    assert max(t.depth for t in fitted["Random Forest"].stages[-1].trees) <= 3
    path = tempfile.mkdtemp(prefix="fleetscope-model-") + "/best"
    assert ML.save_best_model(metrics, fitted, path) == "Linear Regression"
    from pyspark.ml import PipelineModel
    assert [round(c, 6) for c in PipelineModel.load(path).stages[-1].coefficients] == [3.0, -2.0]


def test_save_model(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    path = tempfile.mkdtemp(prefix="fleetscope-model-") + "/m"
    ML.save_model(model, path)
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path)
    assert abs(again.transform(df).first()["prediction"] - 1.0) < 1e-6


def test_text_timestamps_are_parsed(spark):
    df = spark.createDataFrame([("2024-01-01 06:30:00",)], "timestamp string")
    out = with_parsed_timestamp(df)
    assert out.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"
