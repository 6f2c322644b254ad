"""Per-session feature table (op G: 25 features) and its helpers.

One ``groupBy(ident, session_id).agg`` over readings that already carry the
within-session speed change (W6) and the prefix ranks (W9). Each signal is
coerced (bad/missing -> 0, still counted) and filtered on its own range,
expressed as conditional aggregates, not as row filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SESSION_FEATURES
from ..functions.expressions import finite_or, numeric_or_zero, safe_div
from .ordered import attach_group_info
from .sessions import KEYS, feature_session_valid


def signal_columns(df: DataFrame) -> DataFrame:
    """E12 + F7: coerced signals and their validity flags."""
    sp, rpm = numeric_or_zero("position_speed"), numeric_or_zero("can_engine_rpm")
    br, th = numeric_or_zero("can_pedal_brake_status"), numeric_or_zero("can_throttle_pedal_level")
    lim = (numeric_or_zero("limite_velocita") if "limite_velocita" in df.columns else F.lit(0.0))
    return (df.withColumn("_sp", sp).withColumn("_vs", sp >= 0)
              .withColumn("_rpm", rpm).withColumn("_vr", (rpm >= 0) & (rpm <= 10000))
              .withColumn("_br", br).withColumn("_vb", br >= 0)
              .withColumn("_th", th).withColumn("_vt", (th >= 0) & (th <= 100))
              .withColumn("_lim", lim).withColumn("_vl", lim > 0))


def with_gated_alignment(df: DataFrame) -> DataFrame:
    """W6 + W9 for gated readings (``position_speed > 0`` holds, so every speed is
    valid): the speed change is the difference to the previous reading of the
    same session, the speed rank is the row's index in its session, and a row
    enters speed/limit when its limit is positive and its index is within the
    session's count of positive limits. Reuses the sessionization's carries
    (``prev_position_speed``, ``_new``, ``_rc``) instead of new chunked scans.
    """
    df = df.withColumn("_dv", F.when(F.col("_new") == 0, F.col("_sp") - F.col("prev_position_speed")))
    sess = df.groupBy(*KEYS, "session_id").agg(
        F.min("_rc").alias("_rc0"), F.count_if(F.col("_vl")).alias("_nl"),
        F.min("_chunk").alias("_min_chunk"), F.max("_chunk").alias("_max_chunk"))
    df = attach_group_info(df, sess, KEYS, "session_id", ["_rc0", "_nl"])
    keep = F.col("_vl") & (F.col("_rc") - F.col("_rc0") + 1 <= F.col("_nl"))
    return df.withColumn("_ratio", F.when(keep, F.col("_sp") / F.col("_lim"))).drop("_rc0", "_nl")


def _mean(x: Column, valid: Column) -> Column:
    return F.coalesce(F.avg(F.when(valid, x)), F.lit(0.0))


def _std(x: Column, valid: Column) -> Column:
    # sample std; a single value (or none) gives 0
    return F.coalesce(F.stddev_samp(F.when(valid, x)), F.lit(0.0))


def _max(x: Column, valid: Column) -> Column:
    return F.coalesce(F.max(F.when(valid, x)), F.lit(0.0))


def _share(cond: Column, valid: Column) -> Column:
    """A4: 100 * count(cond) / count(valid), 0 when nothing is valid."""
    return safe_div(F.count_if(valid & cond), F.count_if(valid)) * 100


def session_feature_table(rows: DataFrame, min_points: int = 10, min_minutes: float = 5,
                          speed_threshold: float = 0) -> DataFrame:
    """G: one row per valid session (F6) with ``ident``, ``session_id``,
    ``stile_guida`` (mode, smallest on ties) and the 25 features, NaN/inf -> 0."""
    c = F.col
    vs, vr, vb, vt = c("_vs"), c("_vr"), c("_vb"), c("_vt")
    sp, rpm, br, th, dv, ratio = c("_sp"), c("_rpm"), c("_br"), c("_th"), c("_dv"), c("_ratio")
    has_dv = dv.isNotNull()
    agg = rows.groupBy(*KEYS, "session_id").agg(
        F.mode("stile_guida", True).alias("stile_guida"),
        F.count(F.lit(1)).alias("_n"), ((F.max("_t") - F.min("_t")) / 60.0).alias("session_duration"),
        F.max("position_speed").alias("_raw_max_speed"),
        F.count_if(vs).alias("_ns"), F.count_if(vr).alias("_nr"),
        _mean(sp, vs).alias("avg_speed"), _max(sp, vs).alias("max_speed"), _std(sp, vs).alias("speed_std"),
        F.coalesce(F.percentile(F.when(vs, sp), F.lit(0.95)), F.lit(0.0)).alias("speed_95_percentile"),
        _share(sp > 50, vs).alias("time_above_50"),
        _mean(rpm, vr).alias("avg_rpm"), _max(rpm, vr).alias("max_rpm"), _std(rpm, vr).alias("rpm_std"),
        _share(rpm > 3000, vr).alias("high_rpm_ratio"),
        _mean(dv, has_dv & (dv > 0)).alias("avg_acceleration"),
        F.abs(_mean(dv, has_dv & (dv < 0))).alias("avg_deceleration"),
        F.count_if(has_dv & (dv > 5)).cast("double").alias("harsh_acceleration_count"),
        F.count_if(has_dv & (dv < -5)).cast("double").alias("harsh_braking_count"),
        _share(br > 0, vb).alias("brake_usage_ratio"), _mean(br, vb).alias("avg_brake_intensity"),
        _mean(th, vt).alias("avg_throttle"), _max(th, vt).alias("max_throttle"),
        _share(th > 80, vt).alias("aggressive_throttle_ratio"),
        _mean(ratio, ratio.isNotNull()).alias("avg_speed_vs_limit"),
        _share(ratio > 1.1, ratio.isNotNull()).alias("speeding_ratio"),
    )
    agg = (agg.filter(feature_session_valid("_n", "session_duration", "_raw_max_speed",
                                            min_points, min_minutes, speed_threshold))
              .withColumn("total_points", c("_n").cast("double"))
              .withColumn("fuel_efficiency_score",
                          F.when((c("_ns") > 0) & (c("_nr") > 0), safe_div(c("avg_speed"), c("avg_rpm") / 1000))
                           .otherwise(F.lit(0.0)))
              .withColumn("speed_variability", safe_div(c("speed_std"), c("avg_speed")))
              .withColumn("rpm_variability", safe_div(c("rpm_std"), c("avg_rpm"))))
    return agg.select(*KEYS, "session_id", c("stile_guida").cast("int").alias("stile_guida"),
                      *[finite_or(c(f)).alias(f) for f in SESSION_FEATURES])


def sqrt_scaled(df: DataFrame, columns=("avg_rpm", "avg_throttle", "max_throttle", "rpm_std"),
                factor: float = 0.5) -> DataFrame:
    """``sqrt(x) * factor`` on the given columns, as an explicit projection."""
    out = df
    for col in columns:
        out = out.withColumn(col, F.sqrt(F.col(col)) * factor)
    return out
