"""J4 / J5 model training with distributed ``pyspark.ml``.

Data preparation (matrix, label encoding, hash splits, fold column, metrics,
model choice) uses the SQL-checkable operators of ``operators.modeling``. Forests,
linear models are Spark ML's; the boosted models (one
softmax model over all classes, leaf-wise and second-order regressors) are
grown by ``operators.boosting`` from distributed feature histograms.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.constants import FUEL_FEATURES_DASHBOARD, SESSION_FEATURES
from ..operators import boosting as BO
from ..operators import forest as FO
from ..operators import kernel_svm as KS
from ..operators import knn_information as KI
from ..operators import modeling as MO
from ..operators.preparation import Preparation, fit_preparation
from ..session import materialize
from ..sources import model_store as MS
from ..sources.model_store import Fit


@dataclass
class StyleConfig:
    """Defaults of the studied classifier configuration."""
    rf_trees: int = 200
    rf_depth: int = 12
    rf_min_leaf: int = 2            # min_samples_split has no Spark counterpart
    gb_rounds: int = 150
    gb_depth: int = 8
    gb_rate: float = 0.1
    gb_subsample: float = 0.8
    lr_c: float = 1.0
    lr_iter: int = 1000
    lr_tol: float = 1e-4            # the studied configuration sets none: the library default of the original
    svm_c: float = 1.0
    k_features: int = 15
    selection: str = "mutual_info"  # "mutual_info" (nearest neighbours) | "mutual_info_binned" | "anova" | "rfe"
    neighbours: int = 3
    cv_folds: int = 5
    cv_parallelism: int = 5
    test_size: float = 0.2
    seed: int = 42


@dataclass
class StyleResult:
    cv_scores: dict
    models: dict
    best_name: str
    prep: Preparation
    selected: list
    train: DataFrame
    test: DataFrame
    labels: list = field(default_factory=list)


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """weight = n / (k * n_class), from one groupBy over the classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    c = MO._one_row_join(counts, tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(c, label)


def select_features(train: DataFrame, features: list, label: str, cfg: StyleConfig) -> list:
    """M7 / M8 / M9: the ``k`` features to keep (names, in model order)."""
    k = min(cfg.k_features, len(features))
    if cfg.selection == "anova":
        scores = MO.anova_f(train, features, label).fillna(0.0, subset=["f_score"])
        col = "f_score"
    elif cfg.selection == "rfe":
        return _rfe(train, features, label, k, cfg)
    elif cfg.selection == "mutual_info_binned":
        scores, col = MO.mutual_info(train, features, label), "mutual_info"
    else:
        keyed = train if "session_key" in train.columns else with_session_key(train)
        scores, col = KI.mutual_info_knn(keyed, features, label, "session_key", cfg.neighbours, cfg.seed), "mutual_info"
    top = scores.orderBy(F.desc(col), F.asc("feature")).limit(k).collect()   # k rows
    chosen = {r["feature"] for r in top}
    return [f for f in features if f in chosen]


def _rfe(train, features, label, k, cfg):
    """M9: drop the least important feature of a 50-tree forest until ``k`` remain."""
    feats = list(features)
    while len(feats) > k:
        va = VectorAssembler(inputCols=feats, outputCol="_v", handleInvalid="keep")
        rf = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=50, seed=cfg.seed)
        imp = rf.fit(va.transform(train.fillna(0.0, subset=feats))).featureImportances.toArray()
        feats.pop(min(range(len(feats)), key=lambda i: (imp[i], i)))
    return feats


def _classifier(name: str, cfg: StyleConfig, n_train: int):
    common = dict(featuresCol="features", labelCol="label")
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=cfg.rf_trees, maxDepth=cfg.rf_depth, minInstancesPerNode=cfg.rf_min_leaf,
                                      weightCol="weight", seed=cfg.seed, **common)
    if name == "Logistic Regression":
        return LogisticRegression(family="multinomial", regParam=1.0 / (cfg.lr_c * n_train), elasticNetParam=0.0,
                                  maxIter=cfg.lr_iter, tol=cfg.lr_tol, weightCol="weight", **common)
    if name == "SVM":                   # the linear machine; training takes the kernel machine of operators.kernel_svm
        svc = LinearSVC(regParam=1.0 / (cfg.svm_c * n_train))
        return OneVsRest(classifier=svc, weightCol="weight", **common)
    raise ValueError(f"unknown model {name}")


def with_session_key(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session_key", F.concat_ws("_", "ident", F.col("session_id").cast("string")))


def style_matrix(sessions: DataFrame, features=SESSION_FEATURES) -> DataFrame:
    """M1: labelled sessions with ``session_key`` and the available features, nulls as 0."""
    feats = [f for f in features if f in sessions.columns]
    return with_session_key(sessions.filter(F.col("stile_guida").isNotNull())).fillna(0.0, subset=feats)


def cross_validated(estimator, evaluator, train: DataFrame, cfg: StyleConfig):
    """Mean score over the folds of the column ``fold``, and the model of all rows. ``CrossValidator`` fits the folds of a
    single setting one after another; here they and the final model are fitted side by side."""
    def one(fold):
        if fold is None:
            return estimator.copy().fit(train)
        rest, held = train.where(F.col("fold") != fold), train.where(F.col("fold") == fold)
        if rest.isEmpty() or held.isEmpty():
            raise ValueError(f"fold {fold}: no rows to train or to judge on")
        return evaluator.evaluate(estimator.copy().fit(rest).transform(held))
    spark = train.sparkSession
    with ThreadPool(cfg.cv_parallelism + 1) as pool:
        jobs = [pool.apply_async(inheritable_thread_target(spark)(one), (fold,)) for fold in [None, *range(cfg.cv_folds)]]
        model, *scores = [j.get() for j in jobs]
    return sum(map(float, scores)) / max(len(scores), 1), model


def train_style_models(sessions: DataFrame, models=("Random Forest", "Gradient Boosting", "Logistic Regression"),
                       cfg: StyleConfig | None = None, features=SESSION_FEATURES) -> StyleResult:
    """Matrix, encoding, stratified split, preprocessing fitted on the
    training rows, k-fold CV (weighted F1) per model, best model refit on all
    training rows."""
    cfg = cfg or StyleConfig()
    feats = [f for f in features if f in sessions.columns]
    split = materialize(MO.fold_column(MO.hash_split(style_matrix(sessions, features), "session_key", "stile_guida",
                                                     cfg.test_size, cfg.seed), cfg.cv_folds))
    indexer = StringIndexer(inputCol="stile_guida", outputCol="label", stringOrderType="alphabetAsc").fit(split)
    split = balanced_weights(indexer.transform(split))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    selected = select_features(train, feats, "label", cfg)
    prep = fit_preparation(train, selected)
    train_p, test_p = materialize(prep.transform(train, selected)), prep.transform(test, selected)
    n_train = train_p.count()
    evaluator = MulticlassClassificationEvaluator(metricName="f1", labelCol="label", predictionCol="prediction")
    cv_scores, fitted = {}, {}
    for name in models:
        if name == "Gradient Boosting":     # the folds' models grow beside the final one
            boost = BO.BoostConfig(objective="softmax", rounds=cfg.gb_rounds, rate=cfg.gb_rate, max_depth=cfg.gb_depth,
                                   subsample=cfg.gb_subsample, seed=cfg.seed)
            b = BO.fit(train_p, [f"_i_{f}" for f in selected], "label", boost, "session_key", "fold", cfg.cv_folds, len(indexer.labels))
            cv_scores[name] = sum(map(BO.weighted_f1, b.held_out)) / max(len(b.held_out), 1)
            fitted[name] = b.model
            continue
        if name == "SVM":                   # Gaussian kernel, one machine per pair of classes, calibrated
            svm, tables = KS.fit(train_p, len(indexer.labels), cfg.cv_folds, KS.SvmConfig(c=cfg.svm_c, seed=cfg.seed))
            cv_scores[name], fitted[name] = sum(map(BO.weighted_f1, tables)) / max(len(tables), 1), svm
            continue
        cv_scores[name], fitted[name] = cross_validated(_classifier(name, cfg, n_train), evaluator, train_p, cfg)
    best = max(cv_scores, key=lambda n: (cv_scores[n], -list(models).index(n)))
    return StyleResult(cv_scores, fitted, best, prep, selected, train_p, test_p, list(indexer.labels))


def pack_style(res: StyleResult) -> Fit:
    """A result as one stored fit (models, preparation, scores, selection, both matrices)."""
    values = {"cv_scores": res.cv_scores, "best": res.best_name, "prep": asdict(res.prep), "selected": res.selected, "labels": res.labels,
              "order": list(res.models)}
    return Fit({"train": res.train, "test": res.test}, res.models, values)


def unpack_style(fit: Fit) -> StyleResult:
    v = fit.values
    return StyleResult(v["cv_scores"], {n: fit.models[n] for n in v["order"]}, v["best"], Preparation(**v["prep"]), v["selected"],
                       fit.frames["train"], fit.frames["test"], v["labels"])


def style_predictions(res: StyleResult, name: str | None = None) -> DataFrame:
    """Test predictions decoded back to the original labels (``y``, ``prediction``)."""
    pred = res.models[name or res.best_name].transform(res.test)
    dec = IndexToString(inputCol="prediction", outputCol="_pred_label", labels=res.labels)
    return dec.transform(pred).select(F.col("stile_guida").cast("int").alias("y"),
                                      F.col("_pred_label").cast("int").alias("prediction"))


def style_probabilities(res: StyleResult, name: str | None = None) -> DataFrame:
    """One row per test session and class (``session_key, y, prediction, cls, probability``); a session's rows sum to 1.

    Forests, boosting and logistic regression give their own probabilities. One-vs-rest
    models give one margin per class: its logistic value divided by the sum over the classes.
    """
    name = name or res.best_name
    model = res.models[name]
    pred = model.transform(res.test)
    if "probability" in pred.columns:
        p = vector_to_array("probability")
    else:
        one = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-m)))
        total = F.aggregate(one, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(one, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(one)))
    label = F.array(*[F.lit(int(x)) for x in res.labels])
    return (pred.select("session_key", F.col("stile_guida").cast("int").alias("y"),
                        F.element_at(label, F.col("prediction").cast("int") + 1).alias("prediction"),
                        F.posexplode(p).alias("_at", "probability"))
            .select("session_key", "y", "prediction", F.element_at(label, F.col("_at") + 1).alias("cls"), "probability"))


def style_model_scores(res: StyleResult) -> DataFrame:
    """R16 + M14: CV weighted F1 and test weighted F1 of every trained model."""
    rows = []
    for name in res.models:
        m = MO.classification_metrics(style_predictions(res, name)).first()
        rows.append((name, res.cv_scores[name], float(m["f1_score"]), name == res.best_name))
    return res.test.sparkSession.createDataFrame(rows, "model string, cv_f1 double, test_f1 double, best boolean")


def feature_importance(model, names: list) -> list:
    """Importances of a tree model (shares of all splits' gains), else none."""
    model = fitted_estimator(model)
    if isinstance(model, FO.Forest):
        shares = {r["feature"]: r["importance"] for r in model.importances(SparkSession.active()).collect()}
        return [(n, shares.get(n, 0.0)) for n in names]
    if not hasattr(model, "featureImportances"):
        return []
    shares = model.featureImportances
    return list(zip(names, shares.tolist() if hasattr(shares, "tolist") else shares.toArray().tolist()))


def fitted_estimator(model):
    """The estimator of a one-stage pipeline, or the model itself."""
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def style_importances(res: StyleResult, top: int = 10) -> DataFrame:
    """M16 + R17: the ``top`` features of every fitted tree model (``model, best, feature, importance``); linear models have none."""
    rows = [(name, name == res.best_name, f, v) for name, model in res.models.items()
            for f, v in sorted(feature_importance(model, res.selected), key=lambda x: (-x[1], x[0]))[:top]]
    return res.test.sparkSession.createDataFrame(rows, "model string, best boolean, feature string, importance double")


def importance_frame(spark, pairs: list, top: int = 10) -> DataFrame:
    """The ``top`` most important features, descending."""
    df = spark.createDataFrame(pairs, "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)


# ---------------------------------------------------------------- J5 regressors

REGRESSORS = ("Random Forest", "Gradient Boosting", "Linear Regression", "XGBoost")
FOREST_DEPTH = None     # None: grown to purity on tables (operators.forest); a number: Spark ML's forest of that depth


def _boosting(name: str, seed: int) -> BO.BoostConfig | None:
    """Leaf-wise histogram boosting; M20: second-order depth-wise boosting. The studied settings are the defaults of their classes."""
    if name == "Gradient Boosting":
        return BO.BoostConfig(rounds=100, rate=0.1, max_leaves=31, min_leaf=20, stop_after=10, seed=seed)
    if name == "XGBoost":               # the settings of that library's regressor; the library itself is not used
        return BO.BoostConfig(rounds=100, rate=0.3, max_depth=6, l2=1.0, min_hessian=1.0, second_order=True, seed=seed)
    return None


def _regressor(name: str, seed: int, forest_depth: int):
    common = dict(featuresCol="features", labelCol="fuel_delta_smooth")
    if name == "Random Forest":
        return RandomForestRegressor(numTrees=100, maxDepth=forest_depth, seed=seed, **common)
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, **common)
    raise ValueError(name)


def train_fuel_models(training_set: DataFrame, features=FUEL_FEATURES_DASHBOARD, models=REGRESSORS,
                      test_size: float = 0.2, seed: int = 42, forest_depth: int | None = FOREST_DEPTH):
    """Fit each regressor on the hash train split; metrics on the test split.

    Returns (metrics DataFrame [position, name, mse, r2], fitted models dict).
    """
    split = materialize(MO.hash_split(training_set, "id", stratify=False, test_size=test_size, seed=seed))
    va = VectorAssembler(inputCols=list(features), outputCol="features")
    train, test = va.transform(split.filter(~F.col("is_test"))), va.transform(split.filter(F.col("is_test")))
    metrics, fitted = None, {}
    for pos, name in enumerate(models):
        boost = _boosting(name, seed)
        if boost:
            model = BO.fit(train, list(features), "fuel_delta_smooth", boost, "id").model
        elif name == "Random Forest" and forest_depth is None:
            model = FO.grow(train, list(features), "fuel_delta_smooth", "id", FO.ForestConfig(trees=100, seed=seed))
        else:
            model = Pipeline(stages=[_regressor(name, seed, forest_depth)]).fit(train)
        fitted[name] = model
        pred = model.transform(test, "id") if isinstance(model, FO.Forest) else model.transform(test)
        pred = pred.select(F.col("fuel_delta_smooth").alias("y"), "prediction")
        m = MO.regression_metrics(pred).select(F.lit(pos).alias("position"), F.lit(name).alias("name"), "mse", "r2")
        metrics = m if metrics is None else metrics.unionByName(m)
    return metrics, fitted


def save_model(model, path: str) -> None:
    """Persist a fitted model to ``path`` (Spark ML format; this package's own models as tables)."""
    MS.save_model(SparkSession.active(), model, path)


def save_best_model(metrics: DataFrame, fitted: dict, path: str) -> str:
    """M22 + S11: save the model with the best balanced score under ``path``; returns its name."""
    name = MO.best_model_balanced(metrics).first()["name"]
    save_model(fitted[name], path)
    return name
