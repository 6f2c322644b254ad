"""Labelled readings -> driving sessions (30-minute gap) -> 25 features per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, sessions
from ..session import materialize
from ..sources.telemetry import FEATURE_COLUMNS, quality_gate
from ..operators.ordered import attach_key_info
from ..sources.telemetry import SCORING_COLUMNS
from .driving_style import driving_style, label_telemetry, scoring_stages, stage_fleet


def feature_input(labelled: DataFrame) -> DataFrame:
    """S1 for J3: label present (F3) + the gate on ``vehicle_mileage``."""
    return (quality_gate(labelled, "vehicle_mileage")
            .filter(F.col("stile_guida").isNotNull() & F.col("ident").isNotNull())
            .select(*FEATURE_COLUMNS))


def session_features(labelled: DataFrame, gap_minutes: float = 30, min_points: int = 10,
                     min_minutes: float = 5, speed_threshold: float = 0,
                     chunk_seconds: int = 3600) -> DataFrame:
    """G over a telemetry table that already carries ``stile_guida``."""
    staged = sessions.stage_readings(feature_input(labelled), chunk_seconds)
    return features_from_staged(staged, gap_minutes, min_points, min_minutes, speed_threshold, chunk_seconds)


def features_from_staged(staged: DataFrame, gap_minutes: float = 30, min_points: int = 10,
                         min_minutes: float = 5, speed_threshold: float = 0,
                         chunk_seconds: int = 3600) -> DataFrame:
    """G over gated, labelled readings staged on (ident, time chunk)."""
    # sessionized readings feed the session table and the feature aggregate:
    # stored once, in place (partitioning kept)
    rows = materialize(sessions.sessionize_features(staged, gap_minutes, chunk_seconds), keep_partitioning=True)
    # the gate keeps only position_speed > 0, so every speed passes the >= 0 filter
    rows = features.with_gated_alignment(features.signal_columns(rows))
    return features.session_feature_table(rows, min_points, min_minutes, speed_threshold)


def session_features_from_raw(telemetry: DataFrame, materialized: bool = True, chunk_seconds: int = 3600,
                              **kw) -> DataFrame:
    """J2 labels written back (S9), then J3 — the dashboard's data path end to end.

    The readings are staged once for both jobs; each vehicle's label reaches
    its readings through the (vehicle, chunk) table, so the readings are not
    shuffled again. The per-vehicle labels and the per-session table are job
    outputs and are checkpointed for their consumers.
    """
    staged = stage_fleet(telemetry, chunk_seconds)
    styles = scoring_stages(None, chunk_seconds, staged=staged).styles.select("ident", "stile_guida")
    if materialized:
        styles = materialize(styles)
    j3 = staged.filter(F.col("_g3")).select(*SCORING_COLUMNS, "_chunk")
    j3 = attach_key_info(j3, styles, ["ident"], ["stile_guida"]).filter(F.col("stile_guida").isNotNull())
    out = features_from_staged(j3, chunk_seconds=chunk_seconds, **kw)
    return materialize(out) if materialized else out
