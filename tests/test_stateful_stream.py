"""Stateful J2 and J5 streams: any arrival order within the watermark gives the batch result."""
import os
import random
import tempfile

from pyspark.sql import functions as F

from conftest import make_telemetry
from fleetscope.functions.constants import BEHAVIOURS
from fleetscope.operators import fuel, scoring
from fleetscope.plans.driving_style import driving_style, scoring_stages
from fleetscope.sources.telemetry import TELEMETRY_SCHEMA
from fleetscope.streaming import stateful

DELAY = 1800


def readings(seed=5):
    """Four vehicles with sessions of all kinds, repeated times and rows that the gates reject."""
    rnd, rows, no = random.Random(seed), [], 0
    for v in range(4):
        t, km, tank = rnd.randint(0, 500), 1000.0, 50.0
        for _ in range(160):
            t += rnd.choice([0, 2, 5, 10, 30, 60, 300, 599, 600, 601, 4000])
            km, tank, no = km + rnd.random(), tank + rnd.choice([0, 0.5, 1.25, -0.25]), no + 1
            rows.append(dict(id=no, ident=f"v{v}", t=t, position_speed=rnd.choice([0.0, 20.0, 60.0, 95.0]), position_direction=rnd.randint(1, 359),
                             vehicle_mileage=rnd.choice([None, km]), can_throttle_pedal_level=rnd.choice([10, 90]), can_engine_rpm=rnd.choice([900, 4500]),
                             can_pedal_brake_status=rnd.choice([0, 1]), tipo_strada=rnd.choice([None, "primary", "residential", "unclassified"]),
                             can_fuel_consumed=rnd.choice([tank, tank, None])))
    rows.append(dict(id=90_001, ident=None, t=50))
    return rows


def stream_of(spark, rows, batches, seed, last=()):
    """A stream whose batches hold ``rows`` in a random order of arrival, none over ``DELAY`` behind; then a reading long after; then ``last``."""
    rnd = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r["t"] + rnd.uniform(0, DELAY - 1))
    size = -(-len(arrival) // batches)
    folder = tempfile.mkdtemp(prefix="fleetscope-stream-")
    pieces = [arrival[i:i + size] for i in range(0, len(arrival), size)] + [[dict(id=99_999, ident="clock", t=10_000_000)], *last]
    for k, piece in enumerate(pieces):
        path = f"{folder}/{k:03d}.parquet"
        make_telemetry(spark, piece).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(TELEMETRY_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(spark, stream):
    sink = tempfile.mkdtemp(prefix="fleetscope-sink-")
    q = stateful.start(stream, f"{sink}/out", f"{sink}/state", availableNow=True)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink}/out").where("ident <> 'clock'")


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(abs(p - q) <= 1e-9 * max(1, abs(q)) if isinstance(q, float) else p == q for p, q in zip(x, y)), (x, y)


def test_scoring_stream_equals_batch(spark):
    rows = readings()
    batch = scoring_stages(make_telemetry(spark, rows))
    counts = ["ident", "categoria_strada", "fascia_oraria", "tipo_sessione", "n", *[f"n_{b}" for b in BEHAVIOURS]]
    session = ["ident", "session_id", "inizio", "fine", "num_record", F.round("distanza_km", 6), F.round("durata_minuti", 6)]
    want, spans = values(scoring.behaviour_counts(batch.rows), *counts), values(batch.summary, *session)
    assert len(spans) > 30 and len({r[3] for r in want}) >= 2
    for batches, seed in ((1, 1), (9, 2)):
        got = stateful.stages_of_closed(run(spark, stateful.stream_session_counts(stream_of(spark, rows, batches, seed), f"{DELAY} seconds")))
        assert values(got.summary, *session) == spans
        assert values(got.counts, *counts) == want
    style = driving_style(make_telemetry(spark, rows))
    names = sorted(style.columns)
    close(values(got.styles, *names), values(style, *names))


def test_fuel_stream_equals_batch_and_late_rows_are_dropped(spark):
    rows = readings(8)
    series = ["ident", "id", "timestamp", F.round("fuel_delta", 9), F.round("fuel_delta_smooth", 9)]
    want = values(fuel.fuel_series(fuel.fuel_pipeline(make_telemetry(spark, rows))), *series)
    assert len(want) > 60
    late = [[dict(id=70_001, ident="v1", t=100, can_fuel_consumed=1.0), dict(id=70_002, ident="v1", t=200, can_fuel_consumed=900.0)],
            [dict(id=99_998, ident="clock", t=20_000_000)]]                          # long after their time
    for batches, last in ((7, []), (3, late)):
        stream = stateful.stream_fuel_series(stream_of(spark, rows, batches, 4, last), f"{DELAY} seconds")
        assert values(run(spark, stream), *series) == want
