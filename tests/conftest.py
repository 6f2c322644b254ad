import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetscope.session import get_spark
    s = get_spark("local[*]", 8, app_name="fleetscope-tests", extra={"spark.driver.memory": "4g"})
    yield s


BASE = dict(battery_voltage=12.5, can_engine_rpm=2000, can_pedal_brake_status=0, can_throttle_pedal_level=30,
            engine_ignition_status=True, movement_status=True, position_altitude=100, position_direction=90,
            position_latitude=41.5, position_longitude=12.5, position_satellites=8, position_speed=40.0,
            vehicle_mileage=1000.0, can_vehicle_mileage=1000.0, din_1=True, can_fuel_consumed=100.0,
            limite_velocita=50, tipo_strada="primary")

T0 = datetime(2024, 1, 1, 8, 0, 0)


def make_telemetry(spark, rows):
    """rows: dicts with at least id, ident and t (seconds after T0); other fields default to gate-passing values."""
    from fleetscope.sources.telemetry import TELEMETRY_SCHEMA
    out = []
    for r in rows:
        d = dict(BASE)
        d.update({k: v for k, v in r.items() if k != "t"})
        d["timestamp"] = T0 + timedelta(seconds=r["t"])
        out.append(tuple(d.get(f.name) for f in TELEMETRY_SCHEMA.fields))
    return spark.createDataFrame(out, TELEMETRY_SCHEMA)
