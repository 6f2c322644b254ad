"""Fuel consumption: counter deltas (W7, F8), EWM smoothing (W8), fuel reports
and the model input tables (F9, E9, M24), for every vehicle of the fleet at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EWM_SPAN, FUEL_FEATURES_DASHBOARD, FUEL_FEATURES_SCRIPT
from ..functions.expressions import stable_hash_key
from ..sources.telemetry import quality_gate
from ..session import materialize
from .quantiles import exact_quantiles
from .ordered import (CHUNK, attach_key_info, ewm, previous_and_running, previous_value, running_sum,
                      stage_chunks)
from .sessions import KEYS, ORDER, stage_readings


def fuel_input(telemetry: DataFrame, dashboard: bool = False, vehicle: str | None = None) -> DataFrame:
    """S2 + F1/F2 + F4: all columns, fuel counter present, gate (the dashboard
    gate has no altitude/direction bounds), optionally one vehicle."""
    df = quality_gate(telemetry, "can_vehicle_mileage", altitude=not dashboard, direction=not dashboard)
    df = df.filter(F.col("can_fuel_consumed").isNotNull() & F.col("ident").isNotNull())
    if vehicle is not None:
        df = df.filter(F.col("ident") == F.lit(vehicle))
    return df


def earliest_rows(staged: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` readings of each vehicle in (timestamp, id) order."""
    ranked = running_sum(staged, KEYS, ORDER, {"_rank": F.lit(1)})
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def fuel_delta(staged: DataFrame) -> DataFrame:
    """W7 + F8: difference to the previous reading's counter; only positive deltas
    are kept (the first reading of a vehicle has none and is dropped)."""
    df = previous_value(staged, KEYS, ORDER, F.struct(F.col("can_fuel_consumed").alias("v")), "_pf")
    df = df.withColumn("fuel_delta", F.col("can_fuel_consumed") - F.col("_pf.v")).drop("_pf")
    return df.filter(F.col("fuel_delta") > 0)


def fuel_smoothed(deltas: DataFrame, span: int = EWM_SPAN) -> DataFrame:
    """``ewm(span, adjust=False).mean()`` of the positive deltas per vehicle."""
    return ewm(deltas, KEYS, ORDER, "fuel_delta", 2.0 / (span + 1), "fuel_delta_smooth")


def fuel_pipeline(telemetry: DataFrame, dashboard: bool = False, vehicle: str | None = None,
                  limit: int | None = None, span: int = EWM_SPAN, chunk_seconds: int = 3600) -> DataFrame:
    """Gate -> (first ``limit`` readings per vehicle) -> positive deltas -> EWM.

    The kept readings are a prefix of each vehicle's sequence, so a kept
    reading's predecessor is also kept: the rank and the previous counter value
    come from one chunked pass and the limit is applied after the delta.
    """
    staged = stage_readings(fuel_input(telemetry, dashboard, vehicle), chunk_seconds)
    value = F.struct(F.col("can_fuel_consumed").alias("v"))
    if limit is None:
        d = previous_value(staged, KEYS, ORDER, value, "_pf")
    else:
        d = previous_and_running(staged, KEYS, ORDER, value, "_pf", {"_rank": F.lit(1)})
        d = d.filter(F.col("_rank") <= limit).drop("_rank")
    d = d.withColumn("fuel_delta", F.col("can_fuel_consumed") - F.col("_pf.v")).drop("_pf")
    return fuel_smoothed(d.filter(F.col("fuel_delta") > 0), span)


# ---------------------------------------------------------------- reports

def fuel_overview(smoothed: DataFrame) -> DataFrame:
    """Readings, mean delta, speed, rpm and battery voltage per vehicle."""
    return smoothed.groupBy("ident").agg(
        F.count(F.lit(1)).alias("records"), F.avg("fuel_delta").alias("avg_fuel_delta"),
        F.avg("position_speed").alias("avg_speed"), F.avg("can_engine_rpm").alias("avg_rpm"),
        F.avg("battery_voltage").alias("avg_voltage"))


def fuel_stats(smoothed: DataFrame) -> DataFrame:
    """Mean, sample std, 25th and 75th percentile of the smoothed delta per vehicle."""
    x = F.col("fuel_delta_smooth")
    smoothed = materialize(smoothed.select("ident", x))        # read by several aggregates
    spread = smoothed.groupBy("ident").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    return spread.join(exact_quantiles(smoothed, ["ident"], "fuel_delta_smooth", {"q25": 0.25, "q75": 0.75}), "ident", "left")


def fuel_series(smoothed: DataFrame) -> DataFrame:
    """Raw and smoothed delta over time."""
    return smoothed.select("ident", "id", "timestamp", "fuel_delta", "fuel_delta_smooth")


def fuel_preview(smoothed: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` smoothed readings of each vehicle, display columns."""
    ranked = running_sum(smoothed, KEYS, ORDER, {"_rank": F.lit(1)})
    return ranked.filter(F.col("_rank") <= n).select(
        "ident", "id", "timestamp", "battery_voltage", "can_engine_rpm", "position_speed",
        "fuel_delta", "fuel_delta_smooth")


def fuel_scatter_sample(smoothed: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """Up to ``n`` readings per vehicle in a repeatable pseudo-random order.

    Order key md5(seed|id); the first three hex digits form the chunk (4,096 a
    vehicle), so the per-vehicle rank is a chunked running count (balanced for a huge vehicle).
    """
    h = stable_hash_key(seed, F.col("id"))
    df = (smoothed.select("ident", "id", "position_speed", "fuel_delta_smooth", "can_engine_rpm")
                  .withColumn("_h", h).withColumn("_hc", F.conv(F.substring(h, 1, 3), 16, 10).cast("int")))
    df = stage_chunks(df, KEYS, ["_h", "id"], chunk="_hc", checkpoint=False)
    ranked = running_sum(df, KEYS, ["_h", "id"], {"_rank": F.lit(1)}, chunk="_hc")
    return ranked.filter(F.col("_rank") <= n).select(
        "ident", "id", "position_speed", "fuel_delta_smooth", "can_engine_rpm")


def fuel_histogram(smoothed: DataFrame, bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins between each vehicle's min and max smoothed delta
    (the maximum falls in the last bin)."""
    x = F.col("fuel_delta_smooth")
    rng = smoothed.groupBy("ident").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    # the range reaches the readings through their (vehicle, chunk) pairs: no re-shuffle of readings
    j = attach_key_info(smoothed.select("ident", CHUNK, x), rng, ["ident"], ["_lo", "_hi"])
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
               ).otherwise(F.lit(0)).cast("int")
    return (j.withColumn("bin", b)
             .groupBy("ident", "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .select("ident", "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                     (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count"))


def fuel_training_set(smoothed: DataFrame, feature_set: str = "dashboard") -> DataFrame:
    """F9 + E9 + M24: model inputs and target, rows with a missing value dropped.

    ``dashboard``: 5 features, ``vehicle_mileage`` / 10000; ``script``: 8 features.
    """
    feats = FUEL_FEATURES_DASHBOARD if feature_set == "dashboard" else FUEL_FEATURES_SCRIPT
    df = smoothed.select("ident", "id", *feats, "fuel_delta_smooth").dropna(subset=[*feats, "fuel_delta_smooth"])
    if feature_set == "dashboard":
        df = df.withColumn("vehicle_mileage", F.col("vehicle_mileage") / 10000)
    return df
