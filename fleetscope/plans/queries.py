"""Registered queries (one per operator family of the studied jobs)."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..functions.constants import BEHAVIOURS
from ..sources.telemetry import load_telemetry
from ..sources.versioned import VersionedTable, scratch_table
from . import sql as S
from .driving_style import scoring_stages
from .registry import register

STYLE_DOUBLES = ([f"punteggio_{b}" for b in BEHAVIOURS] + [f"punteggio_{b}_norm" for b in BEHAVIOURS]
                 + ["punteggio_finale", "durata_media", "durata_totale", "distanza_totale"])


def _stages(spark, sf_dir):
    return scoring_stages(load_telemetry(spark, sf_dir))


# ------------------------------------------------------------------ J2 scoring

@register("session_summary",
          sql=S.with_ctes(S.TELEMETRY, S.scoring_ctes(), select="""
SELECT ident, session_id, inizio, fine, distanza_km, num_record, durata_minuti FROM summary"""),
          doubles=["distanza_km", "durata_minuti"])
def q_session_summary(spark, sf_dir):
    return _stages(spark, sf_dir).summary.select(
        "ident", "session_id", "inizio", "fine", "distanza_km", "num_record", "durata_minuti")


@register("valid_sessions",
          sql=S.with_ctes(S.TELEMETRY, S.scoring_ctes(), select="""
SELECT ident, session_id, inizio, fine, distanza_km, num_record, durata_minuti FROM valid"""),
          doubles=["distanza_km", "durata_minuti"])
def q_valid_sessions(spark, sf_dir):
    return _stages(spark, sf_dir).valid.select(
        "ident", "session_id", "inizio", "fine", "distanza_km", "num_record", "durata_minuti")


@register("driving_style",
          sql=S.with_ctes(S.TELEMETRY, S.scoring_ctes(), select="SELECT * FROM driving_style"),
          doubles=STYLE_DOUBLES)
def q_driving_style(spark, sf_dir):
    return _stages(spark, sf_dir).styles


# ------------------------------------------------------------------ J3 features

from ..functions.constants import SESSION_FEATURES  # noqa: E402
from .session_features import session_features_from_raw  # noqa: E402

FEATURE_SQL = (S.TELEMETRY, S.scoring_ctes(), S.feature_ctes())


def _features(spark, sf_dir):
    return session_features_from_raw(load_telemetry(spark, sf_dir))


@register("session_features", sql=S.with_ctes(*FEATURE_SQL, select="SELECT * FROM session_features"),
          doubles=list(SESSION_FEATURES))
def q_session_features(spark, sf_dir):
    return _features(spark, sf_dir)


# ------------------------------------------------------------------ J5 fuel

from ..operators import fuel as FU  # noqa: E402

FUEL_SQL = (S.TELEMETRY, S.fuel_ctes())
DASH_LIMIT = 10000          # the ordered limit of fuel_limit alone (default page size); reports read all rows
DASH_SQL = (S.TELEMETRY, S.fuel_ctes(dashboard=True))
LIMIT_SQL = (S.TELEMETRY, S.fuel_ctes(dashboard=True, limit=DASH_LIMIT))
FLEET_VEHICLE = "V7"        # the single-vehicle scan (S2) of the fuel script


def _fuel(spark, sf_dir, dashboard=False, **kw):
    return FU.fuel_pipeline(load_telemetry(spark, sf_dir), dashboard=dashboard, **kw)


@register("fuel_delta", sql=S.with_ctes(*FUEL_SQL, select=
          "SELECT ident, id, timestamp, can_fuel_consumed, fuel_delta FROM fuel_pos"),
          doubles=["can_fuel_consumed", "fuel_delta"])
def q_fuel_delta(spark, sf_dir):
    from ..operators.sessions import stage_readings
    staged = stage_readings(FU.fuel_input(load_telemetry(spark, sf_dir)))
    return FU.fuel_delta(staged).select("ident", "id", "timestamp", "can_fuel_consumed", "fuel_delta")


@register("fuel_ewm", sql=S.with_ctes(*FUEL_SQL, select=
          "SELECT ident, id, timestamp, fuel_delta, fuel_delta_smooth FROM fuel_s"),
          doubles=["fuel_delta", "fuel_delta_smooth"])
def q_fuel_ewm(spark, sf_dir):
    return FU.fuel_series(_fuel(spark, sf_dir))


@register("fuel_scan_vehicle", sql=S.with_ctes(S.TELEMETRY, S.fuel_ctes(), select=
          f"SELECT ident, id, timestamp, fuel_delta, fuel_delta_smooth FROM fuel_s WHERE ident = '{FLEET_VEHICLE}'"),
          doubles=["fuel_delta", "fuel_delta_smooth"])
def q_fuel_scan_vehicle(spark, sf_dir):
    return FU.fuel_series(_fuel(spark, sf_dir, vehicle=FLEET_VEHICLE))


@register("fuel_series", sql=S.with_ctes(*DASH_SQL, select=
          "SELECT ident, id, timestamp, fuel_delta, fuel_delta_smooth FROM fuel_s"),
          doubles=["fuel_delta", "fuel_delta_smooth"])
def q_fuel_series(spark, sf_dir):
    return FU.fuel_series(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_limit", sql=S.with_ctes(*LIMIT_SQL, select="SELECT ident, id, timestamp FROM fuel_lim"))
def q_fuel_limit(spark, sf_dir):
    from ..operators.sessions import stage_readings
    staged = stage_readings(FU.fuel_input(load_telemetry(spark, sf_dir), dashboard=True))
    return FU.earliest_rows(staged, DASH_LIMIT).select("ident", "id", "timestamp")


@register("fuel_overview", sql=S.with_ctes(*DASH_SQL, select="""
SELECT ident, count(*) AS records, avg(fuel_delta) AS avg_fuel_delta, avg(position_speed) AS avg_speed,
  avg(can_engine_rpm) AS avg_rpm, avg(battery_voltage) AS avg_voltage FROM fuel_s GROUP BY ident"""),
          doubles=["avg_fuel_delta", "avg_speed", "avg_rpm", "avg_voltage"])
def q_fuel_overview(spark, sf_dir):
    return FU.fuel_overview(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_stats", sql=S.with_ctes(*DASH_SQL, select="""
SELECT ident, avg(fuel_delta_smooth) AS mean, stddev_samp(fuel_delta_smooth) AS std,
  quantile_cont(fuel_delta_smooth, 0.25) AS q25, quantile_cont(fuel_delta_smooth, 0.75) AS q75
FROM fuel_s GROUP BY ident"""), doubles=["mean", "std", "q25", "q75"])
def q_fuel_stats(spark, sf_dir):
    return FU.fuel_stats(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_preview", sql=S.with_ctes(*DASH_SQL, select="""
SELECT ident, id, timestamp, battery_voltage, can_engine_rpm, position_speed, fuel_delta, fuel_delta_smooth
FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY timestamp, id) AS rk FROM fuel_s) WHERE rk <= 10"""),
          doubles=["battery_voltage", "position_speed", "fuel_delta", "fuel_delta_smooth"])
def q_fuel_preview(spark, sf_dir):
    return FU.fuel_preview(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_scatter_sample", sql=S.with_ctes(*DASH_SQL, select="""
SELECT ident, id, position_speed, fuel_delta_smooth, can_engine_rpm
FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY md5(concat('42', '|', CAST(id AS VARCHAR))), id) AS rk
      FROM fuel_s) WHERE rk <= 1000"""), doubles=["position_speed", "fuel_delta_smooth"])
def q_fuel_scatter_sample(spark, sf_dir):
    return FU.fuel_scatter_sample(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_histogram", sql=S.with_ctes(*DASH_SQL, """
rng AS (SELECT ident, min(fuel_delta_smooth) AS lo, max(fuel_delta_smooth) AS hi FROM fuel_s GROUP BY ident),
binned AS (
  SELECT f.ident, r.lo, r.hi,
    CAST(CASE WHEN r.hi > r.lo THEN least(floor((f.fuel_delta_smooth - r.lo) / (r.hi - r.lo) * 50), 49) ELSE 0 END AS INT) AS bin
  FROM fuel_s f JOIN rng r ON f.ident = r.ident)""", select="""
SELECT ident, bin, lo + bin * ((hi - lo) / 50) AS bin_start, lo + (bin + 1) * ((hi - lo) / 50) AS bin_end, count(*) AS count
FROM binned GROUP BY ident, bin, lo, hi"""), doubles=["bin_start", "bin_end"])
def q_fuel_histogram(spark, sf_dir):
    return FU.fuel_histogram(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_training_set", sql=S.with_ctes(*DASH_SQL, select="""
SELECT ident, id, battery_voltage, can_engine_rpm, can_throttle_pedal_level, position_speed,
  vehicle_mileage / 10000 AS vehicle_mileage, fuel_delta_smooth
FROM fuel_s WHERE battery_voltage IS NOT NULL AND can_engine_rpm IS NOT NULL AND can_throttle_pedal_level IS NOT NULL
  AND position_speed IS NOT NULL AND vehicle_mileage IS NOT NULL AND fuel_delta_smooth IS NOT NULL"""),
          doubles=["battery_voltage", "position_speed", "vehicle_mileage", "fuel_delta_smooth"])
def q_fuel_training_set(spark, sf_dir):
    return FU.fuel_training_set(_fuel(spark, sf_dir, dashboard=True))


@register("fuel_training_set_script", sql=S.with_ctes(*FUEL_SQL, select="""
SELECT ident, id, battery_voltage, can_engine_rpm, can_pedal_brake_status, can_throttle_pedal_level,
  position_altitude, position_direction, position_speed, vehicle_mileage, fuel_delta_smooth
FROM fuel_s WHERE battery_voltage IS NOT NULL AND can_engine_rpm IS NOT NULL AND can_pedal_brake_status IS NOT NULL
  AND can_throttle_pedal_level IS NOT NULL AND position_altitude IS NOT NULL AND position_direction IS NOT NULL
  AND position_speed IS NOT NULL AND vehicle_mileage IS NOT NULL AND fuel_delta_smooth IS NOT NULL"""),
          doubles=["battery_voltage", "position_speed", "vehicle_mileage", "fuel_delta_smooth"])
def q_fuel_training_set_script(spark, sf_dir):
    return FU.fuel_training_set(_fuel(spark, sf_dir), feature_set="script")


# ------------------------------------------------------------------ J2 row-level operators and reports

from ..functions.expressions import road_category as _road_category  # noqa: E402
from ..operators import scoring as SC  # noqa: E402
from ..sources import telemetry as TS  # noqa: E402
from . import reports as R  # noqa: E402

J2 = (S.TELEMETRY, S.scoring_ctes())
FLAG_COLS = [f"f_{b}" for b in BEHAVIOURS]


@register("scan_telemetry", sql=S.with_ctes(*J2, select="SELECT * EXCLUDE (t, time_diff, prev_speed, prev_dir, session_id) FROM sess"),
          doubles=["battery_voltage", "position_latitude", "position_longitude", "position_speed", "vehicle_mileage"])
def q_scan_telemetry(spark, sf_dir):
    return TS.scan_telemetry(load_telemetry(spark, sf_dir), TS.SCORING_COLUMNS)


@register("quality_gate", sql=S.with_ctes(S.TELEMETRY, select=f"""
SELECT id, ident FROM telemetry WHERE {S.gate_sql('vehicle_mileage')}"""))
def q_quality_gate(spark, sf_dir):
    return TS.quality_gate(load_telemetry(spark, sf_dir), "vehicle_mileage").select("id", "ident")


@register("quality_gate_fuel", sql=S.with_ctes(S.TELEMETRY, select=f"""
SELECT id, ident FROM telemetry WHERE can_fuel_consumed IS NOT NULL AND {S.gate_sql(altitude=False, direction=False)}"""))
def q_quality_gate_fuel(spark, sf_dir):
    return FU.fuel_input(load_telemetry(spark, sf_dir), dashboard=True).select("id", "ident")


@register("scan_custom_query", sql=S.with_ctes(S.TELEMETRY, select="""
SELECT ident, count(*) AS readings, max(position_speed) AS max_speed FROM telemetry WHERE movement_status GROUP BY ident"""),
          doubles=["max_speed"])
def q_scan_custom_query(spark, sf_dir):
    load_telemetry(spark, sf_dir).createOrReplaceTempView("telemetry")
    return TS.scan_custom_query(spark, """
        SELECT ident, count(*) AS readings, max(position_speed) AS max_speed
        FROM telemetry WHERE movement_status GROUP BY ident""")


@register("ensure_columns", sql=S.with_ctes(S.TELEMETRY, select="""
SELECT id, limite_velocita, tipo_strada, CAST(NULL AS INT) AS stile_guida FROM telemetry"""))
def q_ensure_columns(spark, sf_dir):
    df = TS.ensure_columns(load_telemetry(spark, sf_dir),
                           {"limite_velocita": "int", "tipo_strada": "string", "stile_guida": "int"})
    return df.select("id", "limite_velocita", "tipo_strada", "stile_guida")


@register("sessionize_scoring", sql=S.with_ctes(*J2, select="""
SELECT id, ident, session_id, ident || '_' || CAST(session_id AS VARCHAR) AS session_unique_id,
  coalesce(time_diff, 0.0) AS time_diff FROM sess"""), doubles=["time_diff"])
def q_sessionize_scoring(spark, sf_dir):
    return _stages(spark, sf_dir).rows.select(
        "id", "ident", "session_id", "session_unique_id",
        F.coalesce(F.col("time_diff"), F.lit(0.0)).alias("time_diff"))


@register("time_band", sql=S.with_ctes(*J2, select="SELECT id, ora, fascia_oraria FROM rows"))
def q_time_band(spark, sf_dir):
    return _stages(spark, sf_dir).rows.select("id", "ora", "fascia_oraria")


@register("row_session_type", sql=S.with_ctes(*J2, select="SELECT id, ident, session_id, tipo_sessione FROM rows"))
def q_row_session_type(spark, sf_dir):
    return _stages(spark, sf_dir).rows.select("id", "ident", "session_id", "tipo_sessione")


@register("road_category", sql=S.with_ctes(S.TELEMETRY, select=f"""
SELECT id, tipo_strada, {S.road_category_sql('tipo_strada')} AS categoria_strada FROM telemetry"""))
def q_road_category(spark, sf_dir):
    t = load_telemetry(spark, sf_dir)
    return t.select("id", "tipo_strada", _road_category(F.col("tipo_strada")).alias("categoria_strada"))


@register("behaviour_flags", sql=S.with_ctes(*J2, select=f"SELECT id, ident, categoria_strada, {', '.join(FLAG_COLS)} FROM flags"))
def q_behaviour_flags(spark, sf_dir):
    return _stages(spark, sf_dir).rows.select("id", "ident", "categoria_strada", *FLAG_COLS)


@register("behaviour_counts", sql=S.with_ctes(*J2, select="SELECT * FROM counts"))
def q_behaviour_counts(spark, sf_dir):
    return _stages(spark, sf_dir).counts


@register("weighted_scores", sql=S.with_ctes(*J2, select="SELECT * FROM partials"),
          doubles=[f"s_{b}" for b in BEHAVIOURS])
def q_weighted_scores(spark, sf_dir):
    return SC.weighted_scores(_stages(spark, sf_dir).counts)


@register("behaviour_scores", sql=S.with_ctes(*J2, select="SELECT * FROM scores"),
          doubles=[f"punteggio_{b}" for b in BEHAVIOURS])
def q_behaviour_scores(spark, sf_dir):
    return SC.behaviour_scores(SC.weighted_scores(_stages(spark, sf_dir).counts))


@register("style_cutpoints", sql=S.with_ctes(*J2, select="SELECT q1, q2 FROM cuts"), doubles=["q1", "q2"])
def q_style_cutpoints(spark, sf_dir):
    return _stages(spark, sf_dir).cuts


@register("vehicle_session_stats", sql=S.with_ctes(*J2, select="SELECT * FROM stats"),
          doubles=["durata_media", "durata_totale", "distanza_totale"])
def q_vehicle_session_stats(spark, sf_dir):
    from ..operators.sessions import vehicle_session_stats
    return vehicle_session_stats(_stages(spark, sf_dir).valid)


@register("update_driving_style", sql=S.with_ctes(*J2, select="""
SELECT t.id, t.ident, d.stile_guida FROM telemetry t LEFT JOIN driving_style d ON t.ident = d.ident"""))
def q_update_driving_style(spark, sf_dir):
    """The labels are written to a table version and read back from it."""
    t = load_telemetry(spark, sf_dir)
    table = VersionedTable.create(t, scratch_table(spark, "telemetry"), "ident")
    styles = _stages(spark, sf_dir).styles.select("ident", "stile_guida")
    return table.update(styles, "ident", ["stile_guida"]).read().select("id", "ident", "stile_guida")


@register("fleet_report", sql=S.with_ctes(*J2, select="""
SELECT v.sessioni_valide, v.durata_media, v.distanza_media, v.sessioni_per_veicolo, p.punteggio_medio, c.q1, c.q2
FROM (SELECT count(*) AS sessioni_valide, avg(durata_minuti) AS durata_media, avg(distanza_km) AS distanza_media,
        count(*) / count(DISTINCT ident) AS sessioni_per_veicolo FROM valid) v,
     (SELECT avg(punteggio_finale) AS punteggio_medio FROM driving_style) p, cuts c"""),
          doubles=["durata_media", "distanza_media", "sessioni_per_veicolo", "punteggio_medio", "q1", "q2"])
def q_fleet_report(spark, sf_dir):
    st = _stages(spark, sf_dir)
    return R.fleet_report(st.valid, st.styles, st.cuts)


@register("time_band_distribution", sql=S.with_ctes(*J2, select="""
SELECT fascia_oraria, count(*) AS records, count(*) / sum(count(*)) OVER () * 100 AS percentuale
FROM rows GROUP BY fascia_oraria"""), doubles=["percentuale"])
def q_time_band_distribution(spark, sf_dir):
    return R.share_distribution(_stages(spark, sf_dir).rows, "fascia_oraria")


@register("session_type_distribution", sql=S.with_ctes(*J2, select="""
SELECT tipo_sessione, count(*) AS records, count(*) / sum(count(*)) OVER () * 100 AS percentuale
FROM rows GROUP BY tipo_sessione"""), doubles=["percentuale"])
def q_session_type_distribution(spark, sf_dir):
    return R.share_distribution(_stages(spark, sf_dir).rows, "tipo_sessione")


@register("vehicle_style_distribution", sql=S.with_ctes(*J2, select="""
SELECT s.stile_guida, count(d.ident) AS veicoli, count(d.ident) / (SELECT count(*) FROM driving_style) * 100 AS percentuale
FROM (SELECT unnest([0, 1, 2]) AS stile_guida) s LEFT JOIN driving_style d ON d.stile_guida = s.stile_guida
GROUP BY s.stile_guida"""), doubles=["percentuale"])
def q_vehicle_style_distribution(spark, sf_dir):
    return R.vehicle_style_distribution(_stages(spark, sf_dir).styles)


@register("risk_event_totals", sql=S.with_ctes(*J2, select="""
SELECT CAST(sum(f_superamenti_limite) AS BIGINT) AS superamenti_limite, CAST(sum(f_frenate_brusche) AS BIGINT) AS frenate_brusche,
  CAST(sum(f_accelerazioni_brusche) AS BIGINT) AS accelerazioni_brusche FROM flags"""))
def q_risk_event_totals(spark, sf_dir):
    return R.risk_event_totals(_stages(spark, sf_dir).rows)


@register("top_aggressive", sql=S.with_ctes(*J2, select="""
SELECT ident, punteggio_finale, num_sessioni, durata_totale FROM driving_style
ORDER BY punteggio_finale DESC, ident LIMIT 5"""), doubles=["punteggio_finale", "durata_totale"])
def q_top_aggressive(spark, sf_dir):
    return R.top_aggressive(_stages(spark, sf_dir).styles)


# ------------------------------------------------------------------ J3 operators and reports

from ..operators.features import sqrt_scaled  # noqa: E402
from .session_features import feature_input  # noqa: E402
from ..operators import sessions as SE  # noqa: E402


@register("sessionize_features", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT id, ident, session_id, gap_min AS time_gap_minutes FROM f_sess"""), doubles=["time_gap_minutes"])
def q_sessionize_features(spark, sf_dir):
    from .driving_style import label_telemetry
    t = load_telemetry(spark, sf_dir)
    staged = SE.stage_readings(feature_input(label_telemetry(t, _stages(spark, sf_dir).styles)))
    rows = SE.sessionize_features(staged)
    return rows.select("id", "ident", "session_id", (F.col("time_diff") / 60.0).alias("time_gap_minutes"))


@register("session_statistics", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT count(*) AS total_sessions, count(DISTINCT ident) AS unique_vehicles, count(DISTINCT stile_guida) AS unique_driving_styles,
  round_even(avg(session_duration), 2) AS avg_session_duration, round_even(avg(avg_speed), 2) AS avg_speed_overall,
  round_even(avg(total_points), 0) AS avg_points_per_session, round_even(max(session_duration), 2) AS longest_session_minutes,
  round_even(min(session_duration), 2) AS shortest_session_minutes FROM session_features"""),
          doubles=["avg_session_duration", "avg_speed_overall", "avg_points_per_session",
                   "longest_session_minutes", "shortest_session_minutes"])
def q_session_statistics(spark, sf_dir):
    return R.session_statistics(_features(spark, sf_dir))


@register("style_distribution", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT stile_guida, count(*) AS count, round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage
FROM session_features GROUP BY stile_guida"""), doubles=["percentage"])
def q_style_distribution(spark, sf_dir):
    return R.style_distribution(_features(spark, sf_dir))


@register("speed_box_by_style", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT stile_guida, min(avg_speed) AS min, quantile_cont(avg_speed, 0.25) AS q1, quantile_cont(avg_speed, 0.5) AS median,
  quantile_cont(avg_speed, 0.75) AS q3, max(avg_speed) AS max FROM session_features GROUP BY stile_guida"""),
          doubles=["min", "q1", "median", "q3", "max"])
def q_speed_box_by_style(spark, sf_dir):
    return R.speed_box_by_style(_features(spark, sf_dir))


@register("session_preview", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT ident, session_id, avg_speed, max_speed, avg_rpm, session_duration, total_points, stile_guida
FROM session_features ORDER BY ident, session_id LIMIT 10"""),
          doubles=["avg_speed", "max_speed", "avg_rpm", "session_duration", "total_points"])
def q_session_preview(spark, sf_dir):
    return R.session_preview(_features(spark, sf_dir))


@register("session_label", sql=S.with_ctes(*FEATURE_SQL, select="SELECT ident, session_id, stile_guida FROM session_features"))
def q_session_label(spark, sf_dir):
    return R.session_label(_features(spark, sf_dir))


@register("sqrt_scaled_features", sql=S.with_ctes(*FEATURE_SQL, select="""
SELECT * REPLACE (sqrt(avg_rpm) * 0.5 AS avg_rpm, sqrt(avg_throttle) * 0.5 AS avg_throttle,
  sqrt(max_throttle) * 0.5 AS max_throttle, sqrt(rpm_std) * 0.5 AS rpm_std) FROM session_features"""),
          doubles=list(SESSION_FEATURES))
def q_sqrt_scaled_features(spark, sf_dir):
    return sqrt_scaled(_features(spark, sf_dir))


# ------------------------------------------------------------------ J1 roads

from ..functions.expressions import web_mercator_x, web_mercator_y  # noqa: E402
from ..operators import roads as RD  # noqa: E402
from ..sources.telemetry import load_roads  # noqa: E402

J1 = (S.TELEMETRY, S.ROADS, S.road_ctes())


def _matches(spark, sf_dir):
    t = load_telemetry(spark, sf_dir)
    points = TS.scan_points(t)
    roads = TS.scan_roads(load_roads(spark, sf_dir))
    return RD.match_points(points, RD.nearest_roads(points, roads))


@register("nearest_road", sql=S.with_ctes(*J1, select="SELECT * FROM matched"),
          doubles=["distance_m"], places={"distance_m": 2})
def q_nearest_road(spark, sf_dir):
    return _matches(spark, sf_dir)


@register("update_road_columns", sql=S.with_ctes(*J1, select="""
SELECT t.id, CASE WHEN m.id IS NOT NULL THEN m.limite_velocita ELSE t.limite_velocita END AS limite_velocita,
  CASE WHEN m.id IS NOT NULL THEN m.tipo_strada ELSE t.tipo_strada END AS tipo_strada
FROM telemetry t LEFT JOIN matched m ON t.id = m.id"""))
def q_update_road_columns(spark, sf_dir):
    """The road columns are written to a table version and read back from it."""
    table = VersionedTable.create(load_telemetry(spark, sf_dir), scratch_table(spark, "telemetry"), "ident")
    m = _matches(spark, sf_dir).select("id", "limite_velocita", "tipo_strada")
    return table.update(m, "id", ["limite_velocita", "tipo_strada"]).read().select("id", "limite_velocita", "tipo_strada")


@register("resolve_speed_limit", sql=S.with_ctes(S.ROADS, select=f"""
SELECT osm_id, highway, maxspeed, {S.speed_limit_sql('maxspeed', 'highway')} AS limite_velocita FROM roads"""))
def q_resolve_speed_limit(spark, sf_dir):
    r = RD.road_speed_limits(load_roads(spark, sf_dir))
    return r.select("osm_id", "highway", F.col("tags")["maxspeed"].alias("maxspeed"), "limite_velocita")


@register("scan_roads", sql=S.with_ctes(S.ROADS, select="SELECT osm_id, highway, 3 AS vertices FROM roads WHERE highway IS NOT NULL"))
def q_scan_roads(spark, sf_dir):
    return TS.scan_roads(load_roads(spark, sf_dir)).select("osm_id", "highway", F.size("way").alias("vertices"))


@register("scan_points", sql=S.with_ctes(S.TELEMETRY, select="""
SELECT id, position_latitude, position_longitude FROM telemetry
WHERE position_latitude IS NOT NULL AND position_longitude IS NOT NULL"""),
          doubles=["position_latitude", "position_longitude"])
def q_scan_points(spark, sf_dir):
    return TS.scan_points(load_telemetry(spark, sf_dir))


_MX, _MY = S.mercator_sql("position_latitude", "position_longitude")


@register("web_mercator", sql=S.with_ctes(S.TELEMETRY, select=f"""
SELECT id, {_MX} AS x, {_MY} AS y FROM telemetry WHERE position_latitude IS NOT NULL AND position_longitude IS NOT NULL"""),
          doubles=["x", "y"], places={"x": 3, "y": 3})
def q_web_mercator(spark, sf_dir):
    p = TS.scan_points(load_telemetry(spark, sf_dir))
    return p.select("id", web_mercator_x(F.col("position_longitude")).alias("x"),
                    web_mercator_y(F.col("position_latitude")).alias("y"))


# ------------------------------------------------------------------ model tables (SQL-checkable)

from ..functions.constants import FUEL_FEATURES_DASHBOARD  # noqa: E402
from ..operators import modeling as MO  # noqa: E402


def _sessions_keyed(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("session_key", F.concat_ws("_", "ident", F.col("session_id").cast("string")))


def _session_split(spark, sf_dir):
    from ..session import materialize
    return materialize(MO.fold_column(MO.hash_split(_sessions_keyed(spark, sf_dir), "session_key", "stile_guida")))


SESSION_SPLIT_SQL = (*FEATURE_SQL, S.split_ctes("session_features", "ident || '_' || CAST(session_id AS VARCHAR)",
                                                "stile_guida", "ssplit"))


@register("stratified_split", sql=S.with_ctes(*SESSION_SPLIT_SQL, select=
          "SELECT split_key AS session_key, stile_guida, is_test FROM ssplit"))
def q_stratified_split(spark, sf_dir):
    return _session_split(spark, sf_dir).select("session_key", "stile_guida", "is_test")


@register("cv_folds", sql=S.with_ctes(*SESSION_SPLIT_SQL, select="SELECT split_key AS session_key, is_test, fold FROM ssplit"))
def q_cv_folds(spark, sf_dir):
    return _session_split(spark, sf_dir).select("session_key", "is_test", "fold")


FUEL_SET_CTE = """
fuel_set AS (
  SELECT ident, id, battery_voltage, can_engine_rpm, can_throttle_pedal_level, position_speed,
    vehicle_mileage / 10000 AS vehicle_mileage, fuel_delta_smooth
  FROM fuel_s WHERE battery_voltage IS NOT NULL AND can_engine_rpm IS NOT NULL AND can_throttle_pedal_level IS NOT NULL
    AND position_speed IS NOT NULL AND vehicle_mileage IS NOT NULL AND fuel_delta_smooth IS NOT NULL)"""
FUEL_SPLIT_SQL = (*DASH_SQL, FUEL_SET_CTE, S.split_ctes("fuel_set", "id", None, "fsplit"))


def _fuel_split(spark, sf_dir):
    from ..session import materialize
    ts = FU.fuel_training_set(_fuel(spark, sf_dir, dashboard=True))
    return materialize(MO.hash_split(materialize(ts), "id", stratify=False))


@register("random_split", sql=S.with_ctes(*FUEL_SPLIT_SQL, select="SELECT id, is_test FROM fsplit"))
def q_random_split(spark, sf_dir):
    return _fuel_split(spark, sf_dir).select("id", "is_test")


from ..operators import knn_information as KI  # noqa: E402
from ..operators import preparation as PR  # noqa: E402
from ..session import materialize  # noqa: E402
from ..sources.model_store import Fit, ModelStore  # noqa: E402
from . import ml as ML  # noqa: E402


@register("anova_f", sql=S.with_ctes(*FEATURE_SQL, """
long AS (UNPIVOT session_features ON {feats} INTO NAME feature VALUE x),
pc AS (SELECT feature, stile_guida AS label, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS ssw FROM long GROUP BY feature, stile_guida),
pc2 AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, count(*) OVER (PARTITION BY feature) AS k,
   sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM pc),
g AS (SELECT feature, sum(n * (m - gm) * (m - gm)) AS ssb, sum(ssw) AS ssw, first(nn) AS n, first(k) AS k FROM pc2 GROUP BY feature)
""".replace("{feats}", ", ".join(SESSION_FEATURES)), select="""
SELECT feature, CASE WHEN ssw > 0 AND k > 1 AND n > k THEN (ssb / (k - 1)) / (ssw / (n - k)) END AS f_score FROM g"""),
          doubles=["f_score"])
def q_anova_f(spark, sf_dir):
    return MO.anova_f(_features(spark, sf_dir), list(SESSION_FEATURES), "stile_guida")


@register("mutual_info", sql=S.with_ctes(*FEATURE_SQL, """
long AS (SELECT stile_guida AS label, feature, x FROM (UNPIVOT session_features ON {feats} INTO NAME feature VALUE x) WHERE x IS NOT NULL),
rng AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY feature),
cells AS (
  SELECT l.feature, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END AS INT) AS bin, label,
    count(*) AS nby
  FROM long l JOIN rng r ON l.feature = r.feature GROUP BY 1, 2, 3),
c2 AS (SELECT *, sum(nby) OVER (PARTITION BY feature) AS n, sum(nby) OVER (PARTITION BY feature, bin) AS nb,
   sum(nby) OVER (PARTITION BY feature, label) AS ny FROM cells)
""".replace("{feats}", ", ".join(SESSION_FEATURES)), select="""
SELECT feature, sum((CAST(nby AS DOUBLE) / n) * ln((CAST(nby AS DOUBLE) * n) / (CAST(nb AS DOUBLE) * ny))) AS mutual_info
FROM c2 GROUP BY feature"""), doubles=["mutual_info"])
def q_mutual_info(spark, sf_dir):
    return MO.mutual_info(_features(spark, sf_dir), list(SESSION_FEATURES), "stile_guida")


@register("mutual_info_knn", sql=S.with_ctes(*FEATURE_SQL, S.knn_information_ctes(SESSION_FEATURES), select="""
SELECT feature, greatest(0.0, psi_n + avg(psi_k) - avg(psi_c) - avg(psi_m)) AS mutual_info FROM terms GROUP BY feature, psi_n"""),
          doubles=["mutual_info"])
def q_mutual_info_knn(spark, sf_dir):
    """M8: the nearest-neighbour estimator, the default selection rule of the classifiers."""
    sessions = materialize(ML.with_session_key(_features(spark, sf_dir)))
    return KI.mutual_info_knn(sessions, list(SESSION_FEATURES), "stile_guida", "session_key")


@register("imputed_medians", sql=S.with_ctes(*FEATURE_SQL, S.quantile_ctes(SESSION_FEATURES), select="""
SELECT feature, median, missing FROM medians"""), doubles=["median"])
def q_imputed_medians(spark, sf_dir):
    """M5: the value that stands in for a missing one, and how many are missing."""
    sessions = materialize(_features(spark, sf_dir))
    feats = list(SESSION_FEATURES)
    gaps = sessions.agg(*[F.count(F.lit(1)).alias("n")], *[F.count(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in feats])
    gaps = gaps.selectExpr(f"stack({len(feats)}, " + ", ".join(f"'{f}', n - `{f}`" for f in feats) + ") AS (feature, missing)")
    return PR.feature_quantiles(sessions, feats, {"median": 0.5}).join(gaps, "feature")


@register("scaled_features", sql=S.with_ctes(*FEATURE_SQL, S.quantile_ctes(SESSION_FEATURES), select="""
SELECT f.ident || '_' || CAST(f.session_id AS VARCHAR) AS session_key, i.feature, (i.x - i.centre) / i.scale AS scaled
FROM session_features f JOIN imputed i ON f.ident = i.ident AND f.session_id = i.session_id"""), doubles=["scaled"])
def q_scaled_features(spark, sf_dir):
    """M6: every session's imputed features, centred on the median and divided by the interquartile range."""
    feats = list(SESSION_FEATURES)
    sessions = materialize(ML.with_session_key(_features(spark, sf_dir)))
    prep = PR.fit_preparation(sessions, feats)
    wide = sessions.select("session_key", *[prep.scaled(f).alias(f) for f in feats])
    return wide.selectExpr("session_key", f"stack({len(feats)}, " + ", ".join(f"'{f}', `{f}`" for f in feats) + ") AS (feature, scaled)")


_CM_SELECT, _CM_PAIRS = S.classification_metrics_sql("cm_pred")


@register("classification_metrics", sql=S.with_ctes(*SESSION_SPLIT_SQL, """
maj AS (SELECT stile_guida AS maj FROM ssplit WHERE NOT is_test GROUP BY stile_guida ORDER BY count(*) DESC, stile_guida LIMIT 1),
cm_pred AS (SELECT stile_guida AS y, (SELECT maj FROM maj) AS prediction FROM ssplit WHERE is_test)""", _CM_PAIRS,
          select=_CM_SELECT), doubles=["accuracy", "precision", "recall", "f1_score"])
def q_classification_metrics(spark, sf_dir):
    """M15 on the majority-class baseline (the floor any classifier must beat)."""
    split = _session_split(spark, sf_dir)
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    maj = (train.groupBy("stile_guida").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), F.asc("stile_guida")).limit(1).select(F.col("stile_guida").alias("prediction")))
    pred = MO._one_row_join(test.select(F.col("stile_guida").alias("y")), maj)
    return MO.classification_metrics(pred)


def _baseline_predictions(split):
    """Mean predictor and one-feature least squares per dashboard feature, fitted on train."""
    y = "fuel_delta_smooth"
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    coef = train.agg(F.avg(y).alias("mean"), *[
        e for f in FUEL_FEATURES_DASHBOARD
        for e in (F.regr_slope(F.col(y), F.col(f).cast("double")).alias(f"b_{f}"),
                  F.regr_intercept(F.col(y), F.col(f).cast("double")).alias(f"a_{f}"))])
    t = MO._one_row_join(test, coef)
    models = [("Mean", F.col("mean"))] + [
        (f"OLS {f}", F.col(f"a_{f}") + F.col(f"b_{f}") * F.col(f).cast("double")) for f in FUEL_FEATURES_DASHBOARD]
    preds = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), e.alias("prediction"))
                                for i, (n, e) in enumerate(models)]))
    return t.select(F.col(y).alias("y"), preds.alias("m")).select("y", "m.*")


def _model_metrics(spark, sf_dir):
    preds = _baseline_predictions(_fuel_split(spark, sf_dir))
    ym = preds.filter(F.col("position") == 0).agg(F.avg("y").alias("_ym"))
    d = MO._one_row_join(preds, ym)
    e, c = F.col("y") - F.col("prediction"), F.col("y") - F.col("_ym")
    return d.groupBy("position", "name").agg(F.avg(e * e).alias("mse"),
                                              (F.lit(1.0) - F.sum(e * e) / F.sum(c * c)).alias("r2"))


def _ols_sql():
    y = "fuel_delta_smooth"
    coefs = ", ".join(f"regr_slope({y}, CAST({f} AS DOUBLE)) AS b_{f}, regr_intercept({y}, CAST({f} AS DOUBLE)) AS a_{f}"
                      for f in FUEL_FEATURES_DASHBOARD)
    arms = [f"SELECT 0 AS position, 'Mean' AS name, {y} AS y, mean AS prediction FROM fsplit, coef WHERE is_test"] + [
        f"SELECT {i + 1}, 'OLS {f}', {y}, a_{f} + b_{f} * CAST({f} AS DOUBLE) FROM fsplit, coef WHERE is_test"
        for i, f in enumerate(FUEL_FEATURES_DASHBOARD)]
    return f"""
coef AS (SELECT avg({y}) AS mean, {coefs} FROM fsplit WHERE NOT is_test),
preds AS ({' UNION ALL '.join(arms)}),
ym AS (SELECT avg(y) AS ym FROM preds WHERE position = 0),
model_metrics AS (
  SELECT CAST(position AS INT) AS position, name, avg((y - prediction) * (y - prediction)) AS mse,
    1.0 - sum((y - prediction) * (y - prediction)) / sum((y - ym) * (y - ym)) AS r2
  FROM preds, ym GROUP BY position, name)"""


MODEL_SQL = (*FUEL_SPLIT_SQL, _ols_sql())


@register("model_metrics", sql=S.with_ctes(*MODEL_SQL, select="SELECT * FROM model_metrics"), doubles=["mse", "r2"])
def q_model_metrics(spark, sf_dir):
    return _model_metrics(spark, sf_dir)


@register("regression_metrics", sql=S.with_ctes(*MODEL_SQL, select=
          "SELECT mse, r2 FROM model_metrics WHERE name = 'OLS position_speed'"), doubles=["mse", "r2"])
def q_regression_metrics(spark, sf_dir):
    preds = _baseline_predictions(_fuel_split(spark, sf_dir)).filter(F.col("name") == "OLS position_speed")
    return MO.regression_metrics(preds)


@register("best_model_balanced", sql=S.with_ctes(*MODEL_SQL, select="""
SELECT name, mse, r2, score FROM (
  SELECT *, (CASE WHEN max(r2) OVER () > min(r2) OVER () THEN (r2 - min(r2) OVER ()) / (max(r2) OVER () - min(r2) OVER ()) ELSE 0.0 END)
          - (CASE WHEN max(mse) OVER () > min(mse) OVER () THEN (mse - min(mse) OVER ()) / (max(mse) OVER () - min(mse) OVER ()) ELSE 0.0 END) AS score
  FROM model_metrics) ORDER BY score DESC, position LIMIT 1"""), doubles=["mse", "r2", "score"])
def q_best_model_balanced(spark, sf_dir):
    return MO.best_model_balanced(_model_metrics(spark, sf_dir))


@register("best_model_r2", sql=S.with_ctes(*MODEL_SQL, select=
          "SELECT name, mse, r2 FROM model_metrics ORDER BY r2 DESC, position LIMIT 1"), doubles=["mse", "r2"])
def q_best_model_r2(spark, sf_dir):
    return MO.best_model_r2(_model_metrics(spark, sf_dir))


@register("model_comparison", sql=S.with_ctes(*MODEL_SQL, select="""
SELECT max(round_even(r2, 4)) AS best_r2, min(round_even(mse, 4)) AS best_mse, avg(round_even(r2, 4)) AS avg_r2,
  avg(round_even(mse, 4)) AS avg_mse FROM model_metrics"""), doubles=["best_r2", "best_mse", "avg_r2", "avg_mse"])
def q_model_comparison(spark, sf_dir):
    return MO.model_comparison(_model_metrics(spark, sf_dir))


# ------------------------------------------------------------------ fitted models (rows-only checks)

STYLE_MODELS = ("Random Forest", "Gradient Boosting", "Logistic Regression")


def _style_result(spark, sf_dir, models=STYLE_MODELS):
    """Fitted once per input, settings and code; the queries below share it."""
    cfg = ML.StyleConfig()
    fit = ModelStore(spark).get_or_fit("style", [f"{sf_dir}/events.parquet"], [list(models), asdict(cfg)], lambda: ML.pack_style(
        ML.train_style_models(_features(spark, sf_dir), models=models, cfg=cfg)))
    return ML.unpack_style(fit)


@register("style_matrix", sql=S.with_ctes(*FEATURE_SQL, select=f"""
SELECT ident || '_' || CAST(session_id AS VARCHAR) AS session_key, stile_guida,
  {', '.join(f'coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}' for f in SESSION_FEATURES)}
FROM session_features WHERE stile_guida IS NOT NULL"""), doubles=list(SESSION_FEATURES))
def q_style_matrix(spark, sf_dir):
    """M1: the matrix that the classifiers are trained on, before it becomes vectors."""
    return ML.style_matrix(_features(spark, sf_dir)).select(
        "session_key", "stile_guida", *[F.col(f).cast("double").alias(f) for f in SESSION_FEATURES])


@register("rfe_features")
def q_rfe_features(spark, sf_dir):
    """M9: the features that recursive elimination keeps, in model order."""
    cfg = ML.StyleConfig(selection="rfe")

    def fit():
        data = ML.StringIndexer(inputCol="stile_guida", outputCol="label", stringOrderType="alphabetAsc")
        matrix = materialize(ML.style_matrix(_features(spark, sf_dir)))
        return Fit(values={"kept": ML.select_features(data.fit(matrix).transform(matrix), list(SESSION_FEATURES), "label", cfg)})
    kept = ModelStore(spark).get_or_fit("rfe", [f"{sf_dir}/events.parquet"], asdict(cfg), fit).values["kept"]
    return spark.createDataFrame(list(enumerate(kept)), "position int, feature string")


@register("style_model_scores")
def q_style_model_scores(spark, sf_dir):
    """M10-M14 + R16: CV and test weighted F1 per classifier."""
    return ML.style_model_scores(_style_result(spark, sf_dir))


@register("style_evaluation")
def q_style_evaluation(spark, sf_dir):
    """M15 on the best classifier's test predictions."""
    res = _style_result(spark, sf_dir)
    return MO.classification_metrics(ML.style_predictions(res)).select(F.lit(res.best_name).alias("model"), "*")


@register("style_probabilities")
def q_style_probabilities(spark, sf_dir):
    """Class probabilities of every test session by the best classifier."""
    return ML.style_probabilities(_style_result(spark, sf_dir))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """M16 + R17: top-10 importances of every tree model, the chosen model marked."""
    return ML.style_importances(_style_result(spark, sf_dir))


@register("svm_evaluation")
def q_svm_evaluation(spark, sf_dir):
    """M13 + M15: the kernel machine (off by default in the comparison): CV and test F1, log loss of its calibrated probabilities."""
    res = _style_result(spark, sf_dir, ("SVM",))
    p = ML.style_probabilities(res)
    loss = p.where("cls = y").agg(F.avg(-F.log(F.greatest("probability", F.lit(1e-12)))).alias("log_loss"))
    return MO._one_row_join(ML.style_model_scores(res), loss).select("model", "cv_f1", "test_f1", "log_loss")


def _fuel_models(spark, sf_dir):
    def fit():
        metrics, fitted = ML.train_fuel_models(materialize(FU.fuel_training_set(_fuel(spark, sf_dir, dashboard=True))))
        return Fit({"metrics": metrics}, fitted)
    stored = ModelStore(spark).get_or_fit("fuel", [f"{sf_dir}/events.parquet"], [str(ML.FOREST_DEPTH), *ML.REGRESSORS], fit)
    return stored.frames["metrics"], stored.models


@register("fuel_model_metrics")
def q_fuel_model_metrics(spark, sf_dir):
    """MSE and R^2 of the four regressors."""
    return _fuel_models(spark, sf_dir)[0]


@register("fuel_best_model")
def q_fuel_best_model(spark, sf_dir):
    """M22 on the fitted regressors."""
    return MO.best_model_balanced(_fuel_models(spark, sf_dir)[0])


@register("fuel_feature_importance")
def q_fuel_feature_importance(spark, sf_dir):
    """R17 for the fuel dashboard: importances of the best tree regressor by R^2."""
    metrics, fitted = _fuel_models(spark, sf_dir)
    ranked = [ML.feature_importance(fitted[r["name"]], list(FUEL_FEATURES_DASHBOARD))
              for r in metrics.orderBy(F.desc("r2"), "position").collect()]               # 4 rows
    return ML.importance_frame(spark, next((x for x in ranked if x), []))


# ------------------------------------------------------------------ streams

def _streamed(spark, sf_dir, make):
    """All readings as a file stream through ``make``; the rows that its sink holds when the input is used up."""
    from ..sources.telemetry import TELEMETRY_SCHEMA
    from ..streaming import stateful
    place = scratch_table(spark, "stream")
    load_telemetry(spark, sf_dir).select(*TELEMETRY_SCHEMA.names).write.parquet(f"{place}/in")
    stream = make(spark.readStream.schema(TELEMETRY_SCHEMA).parquet(f"{place}/in"))
    stateful.start(stream, f"{place}/out", f"{place}/state", availableNow=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


STREAM_DELAY = 1800          # seconds of watermark delay


@register("stream_session_counts", sql=S.with_ctes(*J2, select=f"""
SELECT f.ident, f.session_id, m.inizio, m.fine, m.distanza_km, m.num_record, m.durata_minuti, categoria_strada, fascia_oraria, tipo_sessione,
  count(*) AS n, {", ".join(f"CAST(sum(f_{b}) AS BIGINT) AS n_{b}" for b in BEHAVIOURS)}
FROM flags f JOIN summary m ON f.ident = m.ident AND f.session_id = m.session_id
WHERE m.fine <= (SELECT max(timestamp) FROM gated) - INTERVAL {STREAM_DELAY + 600} SECOND
GROUP BY ALL"""), doubles=["distanza_km", "durata_minuti"])
def q_stream_session_counts(spark, sf_dir):
    """J2 on a stream: the sessions that the last watermark has closed."""
    from ..streaming.stateful import stream_session_counts
    return _streamed(spark, sf_dir, lambda r: stream_session_counts(r, f"{STREAM_DELAY} seconds"))


@register("stream_fuel_series", sql=S.with_ctes(S.TELEMETRY, S.fuel_ctes(), select=f"""
SELECT ident, id, timestamp, fuel_delta, fuel_delta_smooth FROM fuel_s
WHERE timestamp <= (SELECT max(timestamp) FROM fuel_in) - INTERVAL {STREAM_DELAY} SECOND"""), doubles=["fuel_delta", "fuel_delta_smooth"])
def q_stream_fuel_series(spark, sf_dir):
    """J5 on a stream: the readings that the last watermark has passed."""
    from ..streaming.stateful import stream_fuel_series
    return _streamed(spark, sf_dir, lambda r: stream_fuel_series(r, f"{STREAM_DELAY} seconds"))
