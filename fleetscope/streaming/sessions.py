"""Structured Streaming session summary (A1 for a stream of readings).

``session_window`` closes a vehicle's session after ``gap`` without readings;
the watermark bounds how late a reading may arrive and how long open sessions
stay in state. A gap of exactly ``gap`` keeps the session open, the same rule
as the batch split (new session only when the gap is > 600 s). Session ids are
not available on a stream; the window bounds identify a session instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.telemetry import quality_gate


def stream_session_summary(readings: DataFrame, gap: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """Per (vehicle, session window): start, end, distance, readings, minutes."""
    gated = quality_gate(readings, "can_vehicle_mileage").filter(F.col("ident").isNotNull())
    ev = gated.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    agg = (ev.withWatermark("event_time", watermark)
             .groupBy("ident", F.session_window("event_time", gap).alias("session"))
             .agg(F.min("event_time").alias("inizio"), F.max("event_time").alias("fine"),
                  F.max("vehicle_mileage").alias("_mx"), F.min("vehicle_mileage").alias("_mn"),
                  F.count("id").alias("num_record")))
    return agg.select(
        "ident", "session", "inizio", "fine",
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mx") - F.col("_mn")).otherwise(F.lit(0.0)).alias("distanza_km"),
        "num_record",
        ((F.unix_micros("fine") - F.unix_micros("inizio")) / F.lit(6e7)).alias("durata_minuti"))


def start_session_summary(readings: DataFrame, sink_path: str, checkpoint_path: str, **kw):
    """Append closed sessions to a parquet sink (exactly-once via the checkpoint)."""
    return (stream_session_summary(readings, **kw).writeStream.outputMode("append").format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint_path).start())
