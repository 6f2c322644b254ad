"""The streaming session summary agrees with the batch session summary."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from fleetscope.operators import sessions
from fleetscope.plans.driving_style import scoring_input
from fleetscope.sources.telemetry import TELEMETRY_SCHEMA, load_telemetry
from fleetscope.streaming.sessions import stream_session_summary


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="fleetscope-stream-src-")
    t = load_telemetry(spark, SF0001)
    t.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(TELEMETRY_SCHEMA).parquet(src)
    q = (stream_session_summary(stream).writeStream.outputMode("complete").format("memory")
         .queryName("stream_sessions").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT ident, num_record, round(durata_minuti, 6) AS d FROM stream_sessions").collect()
    batch = sessions.session_summary(sessions.sessionize_scoring(sessions.stage_readings(scoring_input(t))))
    exp = batch.select("ident", "num_record", F.round("durata_minuti", 6).alias("d")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exp))
