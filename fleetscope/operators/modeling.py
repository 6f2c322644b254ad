"""Model-table operators that are plain DataFrame algebra (checkable by SQL):
splits (M3, M4), fold column (M14), ANOVA F (M7), binned mutual information (M8),
classification metrics (M15), regression metrics (M21), model selection (M22, M23)
and the comparison report (R15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import stable_hash_key
from .ordered import running_sum, stage_chunks

RANK_DIGITS = 4         # hex digits of the hash that name a rank chunk: 65,536 chunks a stratum


def _one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a global aggregate (exactly one row: a bounded broadcast)."""
    return df.withColumn("_k1", F.lit(0)).join(F.broadcast(one.withColumn("_k1", F.lit(0))), "_k1").drop("_k1")


def hash_split(df: DataFrame, key: str, label: str | None = None, test_size: float = 0.2,
               seed: int = 42, stratify: bool = True) -> DataFrame:
    """M3/M4: repeatable train/test split with exact shares; adds ``is_test`` and ``_rank``.

    Rows are ordered by md5(seed|key) inside their stratum (the label, or one
    stratum when a class has fewer than 2 rows or ``stratify`` is off); the
    first floor(test_size * n + 0.5) rows of each stratum are the test rows.
    The rank is a chunked running count (hash prefix chunks), so one large
    class is not ranked by a single task.
    """
    h = stable_hash_key(seed, F.col(key))
    d = df.withColumn("_h", h).withColumn("_hc", F.conv(F.substring(h, 1, RANK_DIGITS), 16, 10).cast("int"))
    if stratify and label is not None:
        counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
        d = _one_row_join(d, counts.agg(F.min("_nc").alias("_minc")))
        d = d.withColumn("_stratum", F.when(F.col("_minc") >= 2, F.col(label).cast("string"))
                         .otherwise(F.lit("*"))).drop("_minc")
    else:
        d = d.withColumn("_stratum", F.lit("*"))
    sizes = d.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_ns"))
    d = stage_chunks(d, ["_stratum"], ["_h", key], chunk="_hc", checkpoint=False)
    d = running_sum(d, ["_stratum"], ["_h", key], {"_rank": F.lit(1)}, chunk="_hc")
    d = d.join(sizes, "_stratum")
    n_test = F.floor(F.lit(test_size) * F.col("_ns") + F.lit(0.5))
    return d.withColumn("is_test", F.col("_rank") <= n_test).drop("_h", "_hc", "_ns")


def fold_column(split: DataFrame, k: int = 5) -> DataFrame:
    """Stratified fold id 0..k-1 for the training rows (round robin on the hash rank)."""
    return split.withColumn("fold", F.when(~F.col("is_test"), ((F.col("_rank") - 1) % k).cast("int")))


def long_format(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, label, x) rows; ``stack`` keeps it one projection (no join)."""
    args = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    return df.selectExpr(f"`{label}` AS label", f"stack({len(features)}, {args}) AS (feature, x)")


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """M7: one-way ANOVA F statistic per feature (k classes, n rows).

    F = (SSB / (k - 1)) / (SSW / (n - k)), SSW from the per-class population
    variance (stable), SSB from class means; NULL when undefined (SSW = 0).
    """
    xs = {f: F.col(f).cast("double") for f in features}
    wide = df.groupBy(F.col(label).alias("label")).agg(*[
        F.struct(F.lit(f).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("m"),
                 (F.var_pop(x) * F.count(x)).alias("ssw")).alias(f"_{i}") for i, (f, x) in enumerate(xs.items())])
    per_class = wide.select("label", F.explode(F.array(*[f"_{i}" for i in range(len(features))])).alias("_s")).select("label", "_s.*")
    w = Window.partitionBy("feature")
    pc = per_class.withColumn("_N", F.sum("n").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    pc = pc.withColumn("_gm", F.sum(F.col("n") * F.col("m")).over(w) / F.col("_N"))
    g = pc.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("_gm")) * (F.col("m") - F.col("_gm"))).alias("ssb"),
        F.sum("ssw").alias("ssw"), F.first("_N").alias("n"), F.first("_k").alias("k"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return g.select("feature", F.when((F.col("ssw") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k")), f)
                    .alias("f_score"))


def mutual_info(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """M8: mutual information (nats) between each feature, cut in ``bins`` equal-width
    bins over its range, and the label: sum p(b,y) ln(p(b,y) / (p(b) p(y)))."""
    long = long_format(df, features, label).filter(F.col("x").isNotNull())
    rng = long.groupBy("feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    j = long.join(F.broadcast(rng), "feature")            # one row per feature (bounded by the feature list)
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = j.withColumn("bin", b.cast("int")).groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("nby"))
    wf = Window.partitionBy("feature")
    cells = (cells.withColumn("_n", F.sum("nby").over(wf))
                  .withColumn("_nb", F.sum("nby").over(Window.partitionBy("feature", "bin")))
                  .withColumn("_ny", F.sum("nby").over(Window.partitionBy("feature", "label"))))
    term = (F.col("nby") / F.col("_n")) * F.log((F.col("nby") * F.col("_n")) / (F.col("_nb") * F.col("_ny")))
    return cells.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def classification_metrics(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (zero division -> 0)."""
    pairs = pred.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    n = pairs.agg(F.sum("c").alias("_n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c"))).alias("_hit"))
    by_true = pairs.groupBy(F.col("y").alias("cls")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c"))).alias("tp"))
    by_pred = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("c").alias("npred"))
    cls = by_true.join(by_pred, "cls", "full").fillna(0, subset=["support", "tp", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    cls = cls.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1", F.when(F.col("prec") + F.col("rec") > 0,
                     2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0))
    w = cls.agg(F.sum(F.col("prec") * F.col("support")).alias("_p"), F.sum(F.col("rec") * F.col("support")).alias("_r"),
                F.sum(F.col("f1") * F.col("support")).alias("_f"), F.sum("support").alias("_s"))
    out = _one_row_join(n, w)
    return out.select((F.coalesce(F.col("_hit"), F.lit(0)) / F.col("_n")).alias("accuracy"),
                      (F.col("_p") / F.col("_s")).alias("precision"), (F.col("_r") / F.col("_s")).alias("recall"),
                      (F.col("_f") / F.col("_s")).alias("f1_score"))


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """MSE and R^2 = 1 - SSE / SST (SST around the mean of ``y``)."""
    stats = pred.agg(F.avg(y).alias("_ym"), F.count(F.lit(1)).alias("_n"))
    d = _one_row_join(pred, stats)
    e, c = F.col(y) - F.col(p), F.col(y) - F.col("_ym")
    return d.agg(F.avg(e * e).alias("mse"),
                 (F.lit(1.0) - F.sum(e * e) / F.sum(c * c)).alias("r2"))


def best_model_balanced(metrics: DataFrame) -> DataFrame:
    """Min-max scale R^2 and MSE over the models, score = r2' - mse', argmax
    (first model wins ties). A constant column scales to 0."""
    w = Window.partitionBy()      # over the handful of model rows
    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    s = metrics.withColumn("score", scaled("r2") - scaled("mse"))
    return s.orderBy(F.desc("score"), F.asc("position")).limit(1).select("name", "mse", "r2", "score")


def best_model_r2(metrics: DataFrame) -> DataFrame:
    """The model with the highest R^2 (first wins ties)."""
    return metrics.orderBy(F.desc("r2"), F.asc("position")).limit(1).select("name", "mse", "r2")


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Best / mean R^2 and MSE after rounding every metric to 4 places (half-even)."""
    r2, mse = F.bround("r2", 4), F.bround("mse", 4)
    return metrics.agg(F.max(r2).alias("best_r2"), F.min(mse).alias("best_mse"),
                       F.avg(r2).alias("avg_r2"), F.avg(mse).alias("avg_mse"))
