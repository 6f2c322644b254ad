"""Reader options and keyed updates."""
import pytest

from fleetscope.sources.telemetry import jdbc_options, update_by_key


def test_jdbc_query_can_be_partitioned():
    o = jdbc_options("jdbc:x", query="SELECT 1 AS id", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert o["dbtable"] == "(SELECT 1 AS id) AS q" and "query" not in o
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "9", "3")
    assert jdbc_options("jdbc:x", table="t")["dbtable"] == "t"
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "partition_column": "id"}):
        with pytest.raises(ValueError):
            jdbc_options("jdbc:x", **bad)


def test_update_with_repeated_keys_keeps_target_rows(spark):
    target = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 7)], "k int, v int")
    updates = spark.createDataFrame([(1, 4), (1, 5), (2, None), (9, 9)], "k int, v int")
    got = sorted((r.k, r.v if r.v is not None else -1) for r in update_by_key(target, updates, "k", ["v"]).collect())
    assert got == [(1, 5), (1, 5), (2, -1), (3, 7)]


def test_reports_read_more_than_the_limit(spark):
    """One vehicle with more than 10,000 readings: the pipeline keeps them all unless a limit is given."""
    from conftest import make_telemetry
    from fleetscope.operators.fuel import fuel_pipeline
    rows = [dict(id=i, ident="V1", t=i, can_fuel_consumed=float(i)) for i in range(10_200)]
    t = make_telemetry(spark, rows)
    assert fuel_pipeline(t, dashboard=True).count() == 10_199
    assert fuel_pipeline(t, dashboard=True, limit=10_000).count() == 9_999


def test_telemetry_running_sums_do_not_depend_on_chunks(spark, monkeypatch):
    from conftest import SF0001
    from fleetscope.sources import telemetry as TS
    events = TS.read_table(spark, SF0001, "events")
    whole = sorted(tuple(r) for r in TS.telemetry_from_events(events).select("id", "timestamp", "can_fuel_consumed").collect())
    monkeypatch.setattr(TS, "EVENT_CHUNK", 37)
    split = sorted(tuple(r) for r in TS.telemetry_from_events(events).select("id", "timestamp", "can_fuel_consumed").collect())
    assert whole == split and len(whole) == events.count()


def test_gate_bounds(spark):
    """Every edge of the quality gate, with the two mileage columns differing."""
    from conftest import make_telemetry
    from fleetscope.sources.telemetry import quality_gate
    inside = [dict(can_engine_rpm=1), dict(can_engine_rpm=8000), dict(position_latitude=-90.0), dict(position_latitude=90.0),
              dict(position_longitude=-180.0), dict(position_longitude=180.0), dict(position_altitude=-500),
              dict(position_altitude=10000), dict(position_direction=1), dict(position_direction=359),
              dict(position_satellites=5), dict(can_vehicle_mileage=1999999.9), dict(vehicle_mileage=2000000.0)]
    outside = [dict(can_engine_rpm=0), dict(can_engine_rpm=8001), dict(position_latitude=-90.1), dict(position_latitude=90.1),
               dict(position_longitude=-180.1), dict(position_longitude=180.1), dict(position_altitude=-501),
               dict(position_altitude=10001), dict(position_direction=0), dict(position_direction=360),
               dict(position_satellites=4), dict(can_vehicle_mileage=2000000.0), dict(position_speed=0.0), dict(din_1=False),
               dict(engine_ignition_status=False), dict(movement_status=False), dict(can_engine_rpm=None)]
    rows = [dict(id=i, ident="V", t=i, **r) for i, r in enumerate(inside + outside)]
    t = make_telemetry(spark, rows)
    got = {r["id"] for r in quality_gate(t).collect()}
    assert got == set(range(len(inside)))
    other = {r["id"] for r in quality_gate(t, mileage_col="vehicle_mileage").collect()}
    swapped = len(inside) - 1, len(inside) + 11             # the rows whose mileage columns differ in verdict
    assert other == (got - {swapped[0]}) | {swapped[1]}
