"""Sessionization (W1-W3), session summaries (A1, A2) and validity filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (FEATURE_GAP_MINUTES, MIN_SESSION_MINUTES, MIN_SESSION_POINTS,
                                   SCORING_GAP_SECONDS, SPEED_THRESHOLD)
from ..functions.expressions import epoch_seconds, session_type, time_band
from .ordered import CHUNK, add_time_chunk, attach_group_info, stage_chunks

KEYS = ["ident"]
ORDER = ["timestamp", "id"]   # the id tie-break makes equal timestamps deterministic


def stage_readings(df: DataFrame, chunk_seconds: int = 3600, checkpoint: bool = True) -> DataFrame:
    """Add the time chunk and stage the readings on (ident, chunk) in scan order."""
    if CHUNK not in df.columns:
        df = add_time_chunk(df, "timestamp", chunk_seconds)
    return stage_chunks(df, KEYS, ORDER, checkpoint=checkpoint)


def _sessionize(df: DataFrame, is_new, first_is_new: bool, chunk_seconds: int,
                columns: tuple[str, ...] = ("position_speed", "position_direction")) -> DataFrame:
    """Time gap, previous reading, session number and reading count in ONE chunked pass.

    Per (vehicle, chunk): a window gives the in-chunk previous reading, the
    in-chunk session starts and their running count; one chunk summary (first
    time, last reading, starts, rows) is scanned per vehicle to get the carry
    into each chunk (previous reading, whether the chunk's first row starts a
    session, sessions and rows before the chunk); one join on (vehicle, chunk)
    brings it back. ``is_new(gap_seconds)`` is the split rule.
    """
    if CHUNK not in df.columns:
        df = add_time_chunk(df, "timestamp", chunk_seconds)
    w = Window.partitionBy(*KEYS, CHUNK).orderBy(*ORDER)
    reading = F.struct(F.col("_t").alias("t"), *[F.col(c).alias(c) for c in columns])
    d = (df.withColumn("_t", epoch_seconds("timestamp"))
           .withColumn("_lp", F.lag(reading).over(w)))
    d = (d.withColumn("_lnew", F.when(F.col("_lp").isNull(), F.lit(0))
                                .otherwise(is_new(F.col("_t") - F.col("_lp.t")).cast("int")))
          .withColumn("_lcs", F.sum("_lnew").over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_lrc", F.row_number().over(w)))
    chunks = d.groupBy(*KEYS, CHUNK).agg(
        F.min("_t").alias("_ft"), F.max_by(reading, F.struct(*[F.col(o) for o in ORDER])).alias("_last"),
        F.sum("_lnew").alias("_nn"), F.count(F.lit(1)).alias("_n"))
    cw = Window.partitionBy(*KEYS).orderBy(CHUNK)
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_carry", F.lag("_last").over(cw))
    chunks = chunks.withColumn("_fnew", F.when(F.col("_carry").isNull(), F.lit(1 if first_is_new else 0))
                               .otherwise(is_new(F.col("_ft") - F.col("_carry.t")).cast("int")))
    chunks = chunks.select(
        *KEYS, CHUNK, "_carry", "_fnew",
        F.coalesce(F.sum(F.col("_fnew") + F.col("_nn")).over(before), F.lit(0)).alias("_soff"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_roff"))
    out = d.join(chunks, [*KEYS, CHUNK], "left")
    prev = F.coalesce(F.col("_lp"), F.col("_carry"))
    out = out.withColumns({
        "time_diff": F.col("_t") - prev["t"],
        **{f"prev_{c}": prev[c] for c in columns},
        "_new": F.when(F.col("_lrc") == 1, F.col("_fnew")).otherwise(F.col("_lnew")),
        "session_id": (F.col("_soff") + F.col("_fnew") + F.col("_lcs")).cast("long"),
        "_rc": F.col("_roff") + F.col("_lrc"),
    })
    return out.drop("_lp", "_lnew", "_lcs", "_lrc", "_carry", "_fnew", "_soff", "_roff")


def sessionize_scoring(gated: DataFrame, gap_seconds: float = SCORING_GAP_SECONDS,
                       chunk_seconds: int = 3600) -> DataFrame:
    """W1 + W2: new session when the gap to the previous reading is > ``gap_seconds``.

    The first reading of a vehicle has gap 0 and opens session 0; ids count up.
    Adds ``time_diff`` (NULL on a vehicle's first reading), ``prev_position_speed``,
    ``prev_position_direction``, ``session_id`` and ``session_unique_id``.
    """
    df = _sessionize(gated, lambda gap: gap > gap_seconds, False, chunk_seconds)
    return df.withColumn("session_unique_id", F.concat_ws("_", "ident", F.col("session_id").cast("string")))


def sessionize_features(gated: DataFrame, gap_minutes: float = FEATURE_GAP_MINUTES,
                        chunk_seconds: int = 3600) -> DataFrame:
    """W1 + W3: new session when the gap is > ``gap_minutes`` or on the first reading;
    ids start at 1. Also ``_rc``: the reading's number within its vehicle."""
    return _sessionize(gated, lambda gap: (gap / 60.0) > gap_minutes, True, chunk_seconds)


def session_summary(sessionized: DataFrame) -> DataFrame:
    """A1: per (ident, session_id) start, end, distance (0 unless positive), rows, minutes.

    Partial aggregation runs before the exchange, so a huge session only moves
    one partial row per task.
    """
    g = sessionized.groupBy("ident", "session_id").agg(
        F.min("timestamp").alias("inizio"), F.max("timestamp").alias("fine"),
        F.max("vehicle_mileage").alias("_mx"), F.min("vehicle_mileage").alias("_mn"),
        F.count("id").alias("num_record"),
        F.min(CHUNK).alias("_min_chunk"), F.max(CHUNK).alias("_max_chunk"))
    return (g.withColumn("distanza_km", F.when(F.col("_mx") > F.col("_mn"), F.col("_mx") - F.col("_mn"))
                         .otherwise(F.lit(0.0)))
             .withColumn("durata_minuti", (epoch_seconds("fine") - epoch_seconds("inizio")) / 60.0)
             .drop("_mx", "_mn"))


def valid_sessions(summary: DataFrame, min_minutes: float = 5, min_km: float = 0.1,
                   min_records: int = 2) -> DataFrame:
    """duration > 5 min, distance > 0.1 km, at least 2 readings."""
    return summary.filter((F.col("durata_minuti") > min_minutes) & (F.col("distanza_km") > min_km)
                          & (F.col("num_record") >= min_records))


def vehicle_session_stats(valid: DataFrame) -> DataFrame:
    """A2: per vehicle count, mean and total minutes, total km over valid sessions."""
    return valid.groupBy("ident").agg(
        F.count("session_id").alias("num_sessioni"), F.avg("durata_minuti").alias("durata_media"),
        F.sum("durata_minuti").alias("durata_totale"), F.sum("distanza_km").alias("distanza_totale"))


def enrich_rows(sessionized: DataFrame, summary: DataFrame) -> DataFrame:
    """E2-E4 + N5: hour, time band and the type of the row's session on every row."""
    rows = attach_group_info(sessionized, summary, KEYS, "session_id", ["durata_minuti"])
    return rows.withColumns({"ora": F.hour("timestamp"),
                             "fascia_oraria": time_band(F.hour("timestamp")),
                             "tipo_sessione": F.coalesce(session_type("durata_minuti"), F.lit("normale"))})


def feature_session_valid(count_col, duration_col, max_speed_col,
                          min_points: int = MIN_SESSION_POINTS, min_minutes: float = MIN_SESSION_MINUTES,
                          speed_threshold: float = SPEED_THRESHOLD):
    """F6 (inclusive bounds)."""
    return ((F.col(count_col) >= min_points) & (F.col(duration_col) >= min_minutes)
            & (F.col(max_speed_col) >= speed_threshold))
