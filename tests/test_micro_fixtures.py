"""Hand-computed edge cases (FIXTURES.md micro-fixtures)."""

from pyspark.sql import functions as F

from conftest import make_telemetry
from fleetscope.functions.expressions import road_category, safe_div, session_type, speed_limit, time_band
from fleetscope.operators import sessions
from fleetscope.plans.driving_style import scoring_stages


def _rows(spark, rows):
    return {r["id"]: r for r in rows.collect()}


def test_scoring_session_gap_boundary(spark):
    t = make_telemetry(spark, [dict(id=1, ident="A", t=0), dict(id=2, ident="A", t=600), dict(id=3, ident="A", t=1201)])
    st = scoring_stages(t)
    got = _rows(spark, st.rows.select("id", "session_id"))
    assert [got[i]["session_id"] for i in (1, 2, 3)] == [0, 0, 1]   # 600 s same session, 601 s new


def test_feature_session_gap_boundary(spark):
    t = make_telemetry(spark, [dict(id=1, ident="A", t=0), dict(id=2, ident="A", t=1800), dict(id=3, ident="A", t=3601)])
    staged = sessions.stage_readings(t)
    got = _rows(spark, sessions.sessionize_features(staged).select("id", "session_id"))
    assert [got[i]["session_id"] for i in (1, 2, 3)] == [1, 1, 2]   # first row opens session 1


def test_valid_session_bounds_and_distance(spark):
    rows = [dict(id=1, ident="A", t=0, vehicle_mileage=100.0), dict(id=2, ident="A", t=300, vehicle_mileage=100.1),
            dict(id=3, ident="B", t=0, vehicle_mileage=100.0), dict(id=4, ident="B", t=301, vehicle_mileage=100.0),
            dict(id=7, ident="D", t=0, vehicle_mileage=100.0), dict(id=8, ident="D", t=301, vehicle_mileage=99.0),
            dict(id=5, ident="C", t=0, vehicle_mileage=100.0), dict(id=6, ident="C", t=301, vehicle_mileage=100.2)]
    st = scoring_stages(make_telemetry(spark, rows))
    summ = {r["ident"]: r for r in st.summary.collect()}
    assert summ["A"]["durata_minuti"] == 5.0                 # exactly 5 min: not > 5
    assert summ["B"]["distanza_km"] == 0.0                   # flat odometer
    assert summ["D"]["distanza_km"] == 1.0                   # max - min, also when the odometer falls
    assert {r["ident"] for r in st.valid.collect()} == {"C", "D"}


def test_expressions(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 7, 8, 17, 18, 21, 22)], "h int")
    assert [r[0] for r in df.select(time_band(F.col("h"))).collect()] == \
        ["notte", "alba", "alba", "giorno", "giorno", "sera", "sera", "notte"]
    d = spark.createDataFrame([(x,) for x in (29.9, 30.0, 120.0, 120.1)], "d double")
    assert [r[0] for r in d.select(session_type(F.col("d"))).collect()] == ["breve", "normale", "normale", "lunga"]
    c = spark.createDataFrame([(x,) for x in ("motorway", "unclassified", None, "weird", "road")], "r string")
    assert [r[0] for r in c.select(road_category(F.col("r"))).collect()] == \
        ["autostrada", "undefined", "undefined", "undefined", "urbana_secondaria"]
    m = spark.createDataFrame([("90 km/h", "motorway"), ("30;50", "primary"), ("none", "primary"),
                               ("60 mph", "primary"), (None, "residential"), (None, "bridleway"), ("", None)],
                              "m string, h string")
    assert [r[0] for r in m.select(speed_limit(F.col("m"), F.col("h"))).collect()] == [90, 30, 90, 60, 50, -1, -1]
    z = spark.createDataFrame([(1.0, 0.0), (1.0, None), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in z.select(safe_div(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 2.0]


def test_behaviour_flags(spark):
    rows = [
        dict(id=1, ident="A", t=0, position_speed=60.0, limite_velocita=50, tipo_strada=None),          # speeding
        dict(id=2, ident="A", t=100, position_speed=60.0, limite_velocita=50, tipo_strada="unclassified"),
        dict(id=3, ident="A", t=200, position_speed=60.0, limite_velocita=-1),
        dict(id=4, ident="A", t=300, position_speed=60.0, limite_velocita=None),
        dict(id=5, ident="B", t=0, position_direction=359, position_speed=10.0),
        dict(id=6, ident="B", t=5, position_direction=1, position_speed=41.0),                         # 358 deg, 31 km/h in 5 s
        dict(id=7, ident="C", t=0, position_speed=10.0),
        dict(id=8, ident="C", t=11, position_speed=41.0),                                              # 11 s: none
        dict(id=9, ident="D", t=0, can_throttle_pedal_level=None, can_pedal_brake_status=1, position_speed=51.0,
             can_engine_rpm=4001),
    ]
    st = scoring_stages(make_telemetry(spark, rows))
    f = _rows(spark, st.rows)
    assert [f[i]["f_superamenti_limite"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert f[6]["f_sterzate_forti"] == 1 and f[6]["f_fluttuazioni_brusche"] == 1
    assert f[8]["f_fluttuazioni_brusche"] == 0
    assert f[9]["f_accelerazioni_brusche"] == 0 and f[9]["f_frenate_brusche"] == 1 and f[9]["f_uso_alto_rpm"] == 1
    assert sum(r["f_motore_acceso_fermo"] for r in f.values()) == 0        # the gate removed speed-0 rows


def test_labels_and_cut_points(spark):
    # three vehicles with scores 0, x, y: q1 falls on the lowest score -> label 0 (ties go to the lower class)
    rows = [dict(id=1, ident="A", t=0, position_speed=40.0),
            dict(id=2, ident="B", t=0, position_speed=60.0, limite_velocita=50),
            dict(id=3, ident="C", t=0, position_speed=60.0, limite_velocita=50, can_engine_rpm=5000)]
    st = scoring_stages(make_telemetry(spark, rows))
    s = {r["ident"]: r for r in st.styles.collect()}
    assert s["A"]["punteggio_finale"] == 0.0 and s["A"]["stile_guida"] == 0
    assert s["C"]["stile_guida"] == 2
    assert all(r["num_sessioni"] == 0 for r in s.values())                 # no valid session, still labelled


def test_session_features_edges(spark):
    from fleetscope.operators import features
    from fleetscope.plans.session_features import session_features
    rows = [dict(id=i, ident="A", t=60 * i, position_speed=50.0 + (i % 2) * 10, stile_guida=(1 if i < 6 else 2),
                 can_throttle_pedal_level=(None if i == 3 else 50), limite_velocita=(None if i in (1, 2) else 50))
            for i in range(12)]
    t = make_telemetry(spark, [{k: v for k, v in r.items() if k != "stile_guida"} for r in rows])
    lab = spark.createDataFrame([(r["id"], r["stile_guida"]) for r in rows], "id long, stile_guida int")
    df = session_features(t.join(lab, "id"))
    out = df.collect()
    assert len(out) == 1
    r = out[0]
    assert r["stile_guida"] == 1                                             # 6 vs 6: smallest label
    assert r["total_points"] == 12.0 and r["session_duration"] == 11.0
    assert abs(r["avg_throttle"] - 50.0 * 11 / 12) < 1e-9                    # NULL throttle counts as 0
    # limits missing on rows 1, 2: m = min(12 speeds, 10 limits) = 10; speed prefix rows 0..9, limit prefix
    # rows 0, 3..11 -> rows 0, 3..9 are in both (aligned by row, not by position)
    both = [0] + list(range(3, 10))
    assert abs(r["avg_speed_vs_limit"] - sum((50.0 + (i % 2) * 10) / 50.0 for i in both) / len(both)) < 1e-12
    assert r["harsh_acceleration_count"] == 6.0 and r["harsh_braking_count"] == 5.0


def test_fuel_flat_or_falling_dropped(spark):
    from fleetscope.operators.fuel import fuel_pipeline
    rows = [dict(id=i, ident="A", t=60 * i, can_fuel_consumed=v) for i, v in enumerate([10.0, 11.0, 11.0, 10.5, 12.0])]
    out = fuel_pipeline(make_telemetry(spark, rows)).orderBy("id").collect()
    assert [r["id"] for r in out] == [1, 4]
    assert [r["fuel_delta"] for r in out] == [1.0, 1.5]
    a = 2 / 21
    assert abs(out[1]["fuel_delta_smooth"] - ((1 - a) * 1.0 + a * 1.5)) < 1e-15


def test_dashboard_limit_keeps_earliest(spark):
    from fleetscope.operators.fuel import earliest_rows, fuel_input
    rows = [dict(id=10 - i, ident="A", t=60 * i) for i in range(6)]
    staged = sessions.stage_readings(fuel_input(make_telemetry(spark, rows), dashboard=True))
    assert sorted(r["id"] for r in earliest_rows(staged, 3).collect()) == [8, 9, 10]


def test_fuel_limit_inside_pipeline(spark):
    from fleetscope.operators.fuel import fuel_pipeline
    # readings out of id order in time; counter rises by 1.0 each minute
    rows = [dict(id=100 - i, ident="A", t=60 * i, can_fuel_consumed=10.0 + i) for i in range(8)]
    rows += [dict(id=200 + i, ident="B", t=60 * i, can_fuel_consumed=5.0 + 2 * i) for i in range(2)]
    out = fuel_pipeline(make_telemetry(spark, rows), dashboard=True, limit=3).collect()
    got = sorted((r["ident"], r["id"], r["fuel_delta"]) for r in out)
    # A keeps its first 3 readings (ids 100, 99, 98) -> deltas on 99 and 98; B keeps both
    assert got == [("A", 98, 1.0), ("A", 99, 1.0), ("B", 201, 2.0)]
