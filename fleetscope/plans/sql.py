"""Independent SQL (DuckDB dialect) for every table-valued query.

This is the correctness oracle: plain windows over whole vehicles, written
from the operator definitions, run by a different engine over the same
parquet tables. Nothing here is used by the Spark plans.
"""

from __future__ import annotations

from ..functions.constants import (BEHAVIOURS, CATEGORY_WEIGHTS, DEFAULT_SPEEDS, HOUR_MULTIPLIERS,
                                   ROAD_CATEGORIES, SESSION_MULTIPLIERS)


def _case(expr: str, mapping: dict, default: str = "NULL", as_double: bool = False) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)" if as_double else str(v)
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def road_category_sql(expr: str) -> str:
    return f"coalesce({_case(expr, ROAD_CATEGORIES)}, 'undefined')"


def default_speed_sql(expr: str) -> str:
    return _case(expr, DEFAULT_SPEEDS)


def time_band_sql(h: str) -> str:
    return (f"(CASE WHEN {h} >= 6 AND {h} < 8 THEN 'alba' WHEN {h} >= 8 AND {h} < 18 THEN 'giorno' "
            f"WHEN {h} >= 18 AND {h} < 22 THEN 'sera' ELSE 'notte' END)")


def session_type_sql(d: str) -> str:
    return f"(CASE WHEN {d} < 30 THEN 'breve' WHEN {d} <= 120 THEN 'normale' ELSE 'lunga' END)"


def epoch_s(ts: str) -> str:
    return f"(epoch_us({ts}) / 1e6)"


def rnd(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0)"


TELEMETRY = """
telemetry AS (
  WITH e AS (
    SELECT event_id, user_id, event_type, value, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
      CASE WHEN event_id * 53 % 61 = 0 THEN 2700 WHEN event_id * 53 % 23 = 0 THEN 700
           WHEN event_id * 53 % 5 = 0 THEN 4 ELSE 20 + event_id * 7919 % 60 END AS gap_s
    FROM events),
  g AS (SELECT e.*, SUM(gap_s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t_s,
      SUM(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fuel_c FROM e)
  SELECT event_id AS id,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(t_s + user_id * 1777 % 86400 AS BIGINT)) AS timestamp,
    CONCAT('V', CAST(user_id AS VARCHAR)) AS ident,
    12 + k / 50.0::DOUBLE AS battery_voltage, CAST(600 + event_id * 104729 % 4400 AS INT) AS can_engine_rpm,
    CAST(CASE WHEN event_id * 31 % 10 < 2 THEN 1 ELSE 0 END AS INT) AS can_pedal_brake_status,
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(event_id * 6151 % 101 AS INT) END AS can_throttle_pedal_level,
    event_id * 31 % 67 <> 0 AS engine_ignition_status, event_id % 37 <> 0 AS movement_status,
    CAST(event_id * 17 % 900 AS INT) AS position_altitude, CAST(event_id * 3571 % 361 AS INT) AS position_direction,
    41 + (event_id * 1009 % 10000) / 10000.0::DOUBLE AS position_latitude,
    12 + (event_id * 2003 % 9973) / 10000.0::DOUBLE AS position_longitude,
    CAST(4 + event_id * 13 % 10 AS INT) AS position_satellites, (event_id * 7919 % 1301) / 10.0::DOUBLE AS position_speed,
    CAST(100000 + user_id * 1000 + t_s / 100.0::DOUBLE AS DOUBLE) AS vehicle_mileage,
    CAST(100000 + user_id * 1000 + t_s / 100.0::DOUBLE AS DOUBLE) AS can_vehicle_mileage,
    event_id % 29 <> 0 AS din_1,
    fuel_c / 100.0::DOUBLE AS can_fuel_consumed,
    CAST(CASE WHEN k % 9 = 0 THEN -1 WHEN k % 9 = 1 THEN NULL WHEN k % 9 < 4 THEN 50 WHEN k % 9 < 7 THEN 90 ELSE 130 END AS INT) AS limite_velocita,
    CASE WHEN k % 9 = 0 THEN 'unclassified' WHEN k % 9 = 1 THEN NULL WHEN k % 9 = 2 THEN 'residential' WHEN k % 9 = 3 THEN 'tertiary'
         WHEN k % 9 < 7 THEN 'primary' ELSE 'motorway' END AS tipo_strada
  FROM g)"""

ROADS = """
roads AS (
  WITH p AS (
    SELECT p_partkey, p_size,
      6378137.0::DOUBLE * radians(12 + (p_partkey * 1009 % 9973) / 10000.0::DOUBLE) AS px,
      6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(41 + (p_partkey * 2003 % 10000) / 10000.0::DOUBLE) / 2)) AS py
    FROM part)
  SELECT p_partkey AS osm_id,
    CASE p_partkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary'
         WHEN 4 THEN 'residential' WHEN 5 THEN 'footway' WHEN 6 THEN 'bridleway' ELSE NULL END AS highway,
    CASE p_size % 6 WHEN 0 THEN '50' WHEN 1 THEN '90 km/h' WHEN 2 THEN 'none' WHEN 3 THEN '30;50' WHEN 4 THEN '60 mph' ELSE NULL END AS maxspeed,
    px AS x0, py AS y0,
    px + (p_partkey * 37 % 2001 - 1000) AS x1, py + (p_partkey * 91 % 2001 - 1000) AS y1,
    px + (p_partkey * 53 % 3001 - 1500) AS x2, py + (p_partkey * 71 % 3001 - 1500) AS y2
  FROM p)"""

GATE = """din_1 = true AND engine_ignition_status = true AND position_speed > 0 AND movement_status = true
    AND can_engine_rpm BETWEEN 1 AND 8000 AND position_latitude BETWEEN -90 AND 90
    AND position_longitude BETWEEN -180 AND 180 {alt} {dir}
    AND position_satellites > 4 AND {mileage} < 2000000"""


def gate_sql(mileage: str = "can_vehicle_mileage", altitude: bool = True, direction: bool = True) -> str:
    return GATE.format(mileage=mileage,
                       alt="AND position_altitude BETWEEN -500 AND 10000" if altitude else "",
                       dir="AND position_direction BETWEEN 1 AND 359" if direction else "")


SCORING_COLS = ("id, timestamp, ident, battery_voltage, can_engine_rpm, can_pedal_brake_status, "
                "can_throttle_pedal_level, engine_ignition_status, movement_status, position_altitude, "
                "position_direction, position_latitude, position_longitude, position_satellites, "
                "position_speed, vehicle_mileage, din_1, limite_velocita, tipo_strada")


def _weights_sql(b: str) -> str:
    return _case("categoria_strada", {c: w[b] for c, w in CATEGORY_WEIGHTS.items()}, as_double=True)


def scoring_ctes() -> str:
    """J2 as CTEs: gated, lagged, sess, summary, valid, rows, flags, counts, partials,
    scores, normed, cuts, labelled, stats, driving_style."""
    flag_exprs = {
        "superamenti_limite": "limite_velocita > 0 AND tipo_strada IS DISTINCT FROM 'unclassified' AND position_speed > limite_velocita",
        "accelerazioni_brusche": "can_throttle_pedal_level > 80",
        "frenate_brusche": "can_pedal_brake_status = 1 AND position_speed > 50",
        "fluttuazioni_brusche": "abs(position_speed - prev_speed) > 30 AND time_diff <= 10",
        "sterzate_forti": "abs(position_direction - prev_dir) > 45 AND time_diff <= 5",
        "uso_alto_rpm": "can_engine_rpm > 4000",
        "motore_acceso_fermo": "can_engine_rpm > 0 AND position_speed = 0",
    }
    flags = ",\n    ".join(f"CASE WHEN {flag_exprs[b]} THEN 1 ELSE 0 END AS f_{b}" for b in BEHAVIOURS)
    counts = ", ".join(f"CAST(sum(f_{b}) AS BIGINT) AS n_{b}" for b in BEHAVIOURS)
    mh = _case("fascia_oraria", HOUR_MULTIPLIERS, as_double=True)
    ms = _case("tipo_sessione", SESSION_MULTIPLIERS, as_double=True)
    partials = ", ".join(f"n_{b} * {_weights_sql(b)} * {mh} * {ms} AS s_{b}" for b in BEHAVIOURS)
    sums = ", ".join(f"sum(s_{b}) AS punteggio_{b}" for b in BEHAVIOURS)
    norms = ", ".join(f"punteggio_{b} / tot_record AS punteggio_{b}_norm" for b in BEHAVIOURS)
    final = " + ".join(f"punteggio_{b} / tot_record" for b in BEHAVIOURS)
    return f"""
gated AS (SELECT {SCORING_COLS} FROM telemetry WHERE {gate_sql()} AND ident IS NOT NULL),
lagged AS (
  SELECT *, {epoch_s('timestamp')} AS t,
    {epoch_s('timestamp')} - lag({epoch_s('timestamp')}) OVER w AS time_diff,
    lag(position_speed) OVER w AS prev_speed, lag(position_direction) OVER w AS prev_dir
  FROM gated WINDOW w AS (PARTITION BY ident ORDER BY timestamp, id)),
sess AS (
  SELECT *, CAST(SUM(CASE WHEN coalesce(time_diff, 0) > 600 THEN 1 ELSE 0 END)
      OVER (PARTITION BY ident ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
  FROM lagged),
summary AS (
  SELECT ident, session_id, min(timestamp) AS inizio, max(timestamp) AS fine,
    CASE WHEN max(vehicle_mileage) > min(vehicle_mileage) THEN max(vehicle_mileage) - min(vehicle_mileage) ELSE 0.0 END AS distanza_km,
    count(id) AS num_record,
    ({epoch_s('max(timestamp)')} - {epoch_s('min(timestamp)')}) / 60.0 AS durata_minuti
  FROM sess GROUP BY ident, session_id),
valid AS (SELECT * FROM summary WHERE durata_minuti > 5 AND distanza_km > 0.1 AND num_record >= 2),
rows AS (
  SELECT s.*, m.durata_minuti, CAST(hour(s.timestamp) AS INTEGER) AS ora, {time_band_sql('hour(s.timestamp)')} AS fascia_oraria,
    coalesce({session_type_sql('m.durata_minuti')}, 'normale') AS tipo_sessione,
    {road_category_sql('s.tipo_strada')} AS categoria_strada
  FROM sess s LEFT JOIN summary m ON s.ident = m.ident AND s.session_id = m.session_id),
flags AS (SELECT *,
    {flags}
  FROM rows),
counts AS (
  SELECT ident, categoria_strada, fascia_oraria, tipo_sessione, count(*) AS n, {counts}
  FROM flags GROUP BY ident, categoria_strada, fascia_oraria, tipo_sessione),
partials AS (SELECT ident, categoria_strada, fascia_oraria, tipo_sessione, n, {partials} FROM counts),
scores AS (SELECT ident, {sums}, CAST(sum(n) AS BIGINT) AS tot_record FROM partials GROUP BY ident),
normed AS (SELECT *, {norms}, {final} AS punteggio_finale FROM scores),
cuts AS (SELECT quantile_cont(punteggio_finale, 0.33) AS q1, quantile_cont(punteggio_finale, 0.66) AS q2 FROM normed),
labelled AS (
  SELECT n.*, CAST(CASE WHEN punteggio_finale <= q1 THEN 0 WHEN punteggio_finale <= q2 THEN 1 ELSE 2 END AS INT) AS stile_guida
  FROM normed n CROSS JOIN cuts),
stats AS (
  SELECT ident, count(session_id) AS num_sessioni, avg(durata_minuti) AS durata_media,
    sum(durata_minuti) AS durata_totale, sum(distanza_km) AS distanza_totale
  FROM valid GROUP BY ident),
driving_style AS (
  SELECT l.*, coalesce(s.num_sessioni, 0) AS num_sessioni, coalesce(s.durata_media, 0) AS durata_media,
    coalesce(s.durata_totale, 0) AS durata_totale, coalesce(s.distanza_totale, 0) AS distanza_totale
  FROM labelled l LEFT JOIN stats s ON l.ident = s.ident)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + select


FEATURE_COLS = SCORING_COLS + ", stile_guida"


def feature_ctes() -> str:
    """J3 over the J2 labels: labelled, fgated, f_lag, f_sess, f_vals, f_dv, f_rs, f_rl,
    f_rows, f_mode, session_features. Needs ``scoring_ctes`` before it."""
    ok_s, ok_r, ok_b, ok_t = "sp >= 0", "rpm >= 0 AND rpm <= 10000", "br >= 0", "th >= 0 AND th <= 100"

    def share(cond, valid):
        return (f"CASE WHEN count(*) FILTER (WHERE {valid}) = 0 THEN 0.0 ELSE "
                f"(CAST(count(*) FILTER (WHERE {valid} AND {cond}) AS DOUBLE) / count(*) FILTER (WHERE {valid})) * 100 END")

    def mean(x, valid):
        return f"coalesce(avg({x}) FILTER (WHERE {valid}), 0.0)"

    def std(x, valid):
        return f"coalesce(stddev_samp({x}) FILTER (WHERE {valid}), 0.0)"

    def mx(x, valid):
        return f"coalesce(max({x}) FILTER (WHERE {valid}), 0.0)"

    def sdiv(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"

    return f"""
tlabelled AS (SELECT t.*, d.stile_guida FROM telemetry t LEFT JOIN driving_style d ON t.ident = d.ident),
fgated AS (SELECT {FEATURE_COLS} FROM tlabelled
  WHERE stile_guida IS NOT NULL AND ident IS NOT NULL AND {gate_sql('vehicle_mileage')}),
f_lag AS (
  SELECT *, {epoch_s('timestamp')} AS t,
    ({epoch_s('timestamp')} - lag({epoch_s('timestamp')}) OVER (PARTITION BY ident ORDER BY timestamp, id)) / 60.0 AS gap_min
  FROM fgated),
f_sess AS (
  SELECT *, CAST(SUM(CASE WHEN gap_min IS NULL OR gap_min > 30 THEN 1 ELSE 0 END)
      OVER (PARTITION BY ident ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
  FROM f_lag),
f_vals AS (
  SELECT *, coalesce(TRY_CAST(position_speed AS DOUBLE), 0.0) AS sp, coalesce(TRY_CAST(can_engine_rpm AS DOUBLE), 0.0) AS rpm,
    coalesce(TRY_CAST(can_pedal_brake_status AS DOUBLE), 0.0) AS br, coalesce(TRY_CAST(can_throttle_pedal_level AS DOUBLE), 0.0) AS th,
    coalesce(TRY_CAST(limite_velocita AS DOUBLE), 0.0) AS lim
  FROM f_sess),
f_dv AS (
  SELECT id, sp - lag(sp) OVER (PARTITION BY ident, session_id ORDER BY timestamp, id) AS dv,
    row_number() OVER (PARTITION BY ident, session_id ORDER BY timestamp, id) AS rs,
    count(*) OVER (PARTITION BY ident, session_id) AS ns
  FROM f_vals WHERE sp >= 0),
f_rl AS (
  SELECT id, row_number() OVER (PARTITION BY ident, session_id ORDER BY timestamp, id) AS rl,
    count(*) OVER (PARTITION BY ident, session_id) AS nl
  FROM f_vals WHERE lim > 0),
f_rows AS (
  SELECT v.*, d.dv,
    CASE WHEN d.rs IS NOT NULL AND l.rl IS NOT NULL AND d.rs <= least(d.ns, l.nl) AND l.rl <= least(d.ns, l.nl)
         THEN v.sp / v.lim END AS ratio,
    count(*) OVER (PARTITION BY v.ident, v.session_id, v.stile_guida) AS lab_n
  FROM f_vals v LEFT JOIN f_dv d ON v.id = d.id LEFT JOIN f_rl l ON v.id = l.id),
f_mode AS (SELECT *, max(lab_n) OVER (PARTITION BY ident, session_id) AS lab_max FROM f_rows),
f_agg AS (
  SELECT ident, session_id,
    CAST(min(stile_guida) FILTER (WHERE lab_n = lab_max) AS INT) AS stile_guida,
    count(*) AS n, (max(t) - min(t)) / 60.0 AS session_duration, max(position_speed) AS raw_max_speed,
    count(*) FILTER (WHERE {ok_s}) AS n_s, count(*) FILTER (WHERE {ok_r}) AS n_r,
    {mean('sp', ok_s)} AS avg_speed, {mx('sp', ok_s)} AS max_speed, {std('sp', ok_s)} AS speed_std,
    coalesce(quantile_cont(sp, 0.95) FILTER (WHERE {ok_s}), 0.0) AS speed_95_percentile,
    {share('sp > 50', ok_s)} AS time_above_50,
    {mean('rpm', ok_r)} AS avg_rpm, {mx('rpm', ok_r)} AS max_rpm, {std('rpm', ok_r)} AS rpm_std,
    {share('rpm > 3000', ok_r)} AS high_rpm_ratio,
    {mean('dv', 'dv > 0')} AS avg_acceleration, abs({mean('dv', 'dv < 0')}) AS avg_deceleration,
    CAST(count(*) FILTER (WHERE dv > 5) AS DOUBLE) AS harsh_acceleration_count,
    CAST(count(*) FILTER (WHERE dv < -5) AS DOUBLE) AS harsh_braking_count,
    {share('br > 0', ok_b)} AS brake_usage_ratio, {mean('br', ok_b)} AS avg_brake_intensity,
    {mean('th', ok_t)} AS avg_throttle, {mx('th', ok_t)} AS max_throttle, {share('th > 80', ok_t)} AS aggressive_throttle_ratio,
    {mean('ratio', 'ratio IS NOT NULL')} AS avg_speed_vs_limit, {share('ratio > 1.1', 'ratio IS NOT NULL')} AS speeding_ratio
  FROM f_mode GROUP BY ident, session_id),
session_features AS (
  SELECT ident, session_id, stile_guida, session_duration, CAST(n AS DOUBLE) AS total_points,
    avg_speed, max_speed, speed_std, speed_95_percentile, time_above_50, avg_rpm, max_rpm, rpm_std,
    high_rpm_ratio, avg_acceleration, avg_deceleration, harsh_acceleration_count, harsh_braking_count,
    brake_usage_ratio, avg_brake_intensity, avg_throttle, max_throttle, aggressive_throttle_ratio,
    CASE WHEN n_s > 0 AND n_r > 0 THEN {sdiv('avg_speed', 'avg_rpm / 1000')} ELSE 0.0 END AS fuel_efficiency_score,
    avg_speed_vs_limit, speeding_ratio,
    {sdiv('speed_std', 'avg_speed')} AS speed_variability, {sdiv('rpm_std', 'avg_rpm')} AS rpm_variability
  FROM f_agg WHERE n >= 10 AND session_duration >= 5 AND raw_max_speed >= 0)"""


def fuel_ctes(dashboard: bool = False, limit: int | None = None, span: int = 20) -> str:
    """J5 as CTEs: fuel_in, fuel_lim, fuel_d, fuel_pos, fuel_s (EWM by list fold)."""
    alpha = 2.0 / (span + 1)
    q = 1.0 - alpha
    gate = gate_sql("can_vehicle_mileage", altitude=not dashboard, direction=not dashboard)
    lim = (f"SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY timestamp, id) AS rk "
           f"FROM fuel_in) WHERE rk <= {limit}") if limit is not None else "SELECT * FROM fuel_in"
    return f"""
fuel_in AS (SELECT * FROM telemetry WHERE can_fuel_consumed IS NOT NULL AND ident IS NOT NULL AND {gate}),
fuel_lim AS ({lim}),
fuel_d AS (SELECT *, can_fuel_consumed - lag(can_fuel_consumed) OVER (PARTITION BY ident ORDER BY timestamp, id) AS fuel_delta
  FROM fuel_lim),
fuel_pos AS (SELECT * FROM fuel_d WHERE fuel_delta > 0),
fuel_s AS (
  SELECT *, list_reduce(list(fuel_delta) OVER (PARTITION BY ident ORDER BY timestamp, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: a * {q!r} + b * {alpha!r}) AS fuel_delta_smooth
  FROM fuel_pos)"""


def speed_limit_sql(maxspeed: str, highway: str) -> str:
    digits = f"regexp_extract(coalesce({maxspeed}, ''), '(\\d+)', 1)"
    return f"CAST(coalesce(TRY_CAST(nullif({digits}, '') AS INT), {default_speed_sql(highway)}, -1) AS INT)"


def mercator_sql(lat: str, lon: str) -> tuple[str, str]:
    return (f"(6378137.0::DOUBLE * radians({lon}))",
            f"(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({lat}) / 2)))")


def road_ctes() -> str:
    """J1 brute force: road_ok, segs, pts, cand, best (nearest segment per distinct point)."""
    px, py = mercator_sql("lat", "lon")
    dist = ("sqrt((px - (sx0 + t * (sx1 - sx0))) * (px - (sx0 + t * (sx1 - sx0))) "
            "+ (py - (sy0 + t * (sy1 - sy0))) * (py - (sy0 + t * (sy1 - sy0))))")
    return f"""
road_ok AS (SELECT *, {speed_limit_sql('maxspeed', 'highway')} AS limite_velocita FROM roads WHERE highway IS NOT NULL),
segs AS (
  SELECT osm_id, highway, limite_velocita, x0 AS sx0, y0 AS sy0, x1 AS sx1, y1 AS sy1 FROM road_ok
  UNION ALL SELECT osm_id, highway, limite_velocita, x1, y1, x2, y2 FROM road_ok),
pts AS (
  SELECT lat, lon, {px} AS px, {py} AS py FROM (
    SELECT DISTINCT position_latitude AS lat, position_longitude AS lon FROM telemetry
    WHERE position_latitude IS NOT NULL AND position_longitude IS NOT NULL)),
cand AS (
  SELECT p.lat, p.lon, s.osm_id, s.highway, s.limite_velocita, p.px, p.py, s.sx0, s.sy0, s.sx1, s.sy1,
    CASE WHEN (s.sx1 - s.sx0) * (s.sx1 - s.sx0) + (s.sy1 - s.sy0) * (s.sy1 - s.sy0) = 0 THEN 0.0
         ELSE least(1.0, greatest(0.0, ((p.px - s.sx0) * (s.sx1 - s.sx0) + (p.py - s.sy0) * (s.sy1 - s.sy0))
              / ((s.sx1 - s.sx0) * (s.sx1 - s.sx0) + (s.sy1 - s.sy0) * (s.sy1 - s.sy0)))) END AS t
  FROM pts p CROSS JOIN segs s),
dists AS (SELECT lat, lon, osm_id, highway, limite_velocita, {dist} AS distance_m FROM cand),
best AS (SELECT * FROM dists QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY distance_m, osm_id) = 1),
matched AS (
  SELECT t.id, CAST(coalesce(b.limite_velocita, -1) AS INT) AS limite_velocita, coalesce(b.highway, 'unknown') AS tipo_strada,
    b.osm_id, b.distance_m
  FROM telemetry t LEFT JOIN best b ON t.position_latitude = b.lat AND t.position_longitude = b.lon
  WHERE t.position_latitude IS NOT NULL AND t.position_longitude IS NOT NULL)"""


def split_ctes(src: str, key_expr: str, label: str | None, name: str, test_size: float = 0.2,
               seed: int = 42, k_folds: int = 5) -> str:
    """Hash split of ``src``: <name>_k, <name> (with is_test, rk, fold)."""
    if label is None:
        stratum = "'*'"
    else:
        stratum = (f"CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM {src} GROUP BY {label})) >= 2 "
                   f"THEN CAST({label} AS VARCHAR) ELSE '*' END")
    return f"""
{name}_k AS (SELECT *, {key_expr} AS split_key, {stratum} AS stratum FROM {src}),
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('{seed}', '|', CAST(split_key AS VARCHAR))), split_key) AS rk,
    count(*) OVER (PARTITION BY stratum) AS ns
  FROM {name}_k),
{name} AS (
  SELECT *, rk <= floor({test_size!r} * ns + 0.5) AS is_test,
    CASE WHEN NOT (rk <= floor({test_size!r} * ns + 0.5)) THEN CAST((rk - 1) % {k_folds} AS INT) END AS fold
  FROM {name}_r)"""


def classification_metrics_sql(pred: str) -> str:
    return f"""
SELECT CAST((SELECT sum(CASE WHEN y = p THEN c ELSE 0 END) FROM cm_pairs) AS DOUBLE) / (SELECT sum(c) FROM cm_pairs) AS accuracy,
  sum(prec * support) / sum(support) AS precision, sum(rec * support) / sum(support) AS recall,
  sum(f1 * support) / sum(support) AS f1_score
FROM (
  SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM (
    SELECT *, CASE WHEN npred > 0 THEN CAST(tp AS DOUBLE) / npred ELSE 0.0 END AS prec,
      CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM (
      SELECT coalesce(bt.cls, bp.cls) AS cls, coalesce(bt.support, 0) AS support, coalesce(bt.tp, 0) AS tp,
        coalesce(bp.npred, 0) AS npred
      FROM (SELECT y AS cls, sum(c) AS support, sum(CASE WHEN y = p THEN c ELSE 0 END) AS tp FROM cm_pairs GROUP BY y) bt
      FULL OUTER JOIN (SELECT p AS cls, sum(c) AS npred FROM cm_pairs GROUP BY p) bp ON bt.cls = bp.cls)))""", \
        f"cm_pairs AS (SELECT y, prediction AS p, count(*) AS c FROM {pred} GROUP BY y, prediction)"


def knn_information_ctes(features) -> str:
    """M8 by all pairs: (feature, psi terms) of every row; digamma of an integer from its harmonic sum."""
    def psi(n):
        return f"(coalesce(list_sum(list_transform(range(1, CAST({n} AS BIGINT)), lambda i: 1.0 / i)), 0.0) - 0.5772156649015329)"
    return f"""
kn_long AS (SELECT ident || '_' || CAST(session_id AS VARCHAR) AS key, stile_guida AS label, feature, x
  FROM (UNPIVOT session_features ON {', '.join(features)} INTO NAME feature VALUE x) WHERE x IS NOT NULL AND stile_guida IS NOT NULL),
kn_top AS (SELECT *, max(abs(x)) OVER (PARTITION BY feature) AS top, count(*) OVER (PARTITION BY feature, label) AS n_c FROM kn_long),
kn AS (SELECT key, label, feature, n_c,
    (CASE WHEN top > 0 THEN CAST(floor(x / top * 1125899906842624.0) AS BIGINT) ELSE 0 END)
    + ('0x' || substr(md5('42|' || feature || '|' || key), 1, 4))::BIGINT - 32768 AS v
  FROM kn_top WHERE n_c > 1),
kn_r AS (SELECT a.feature, a.key, a.label, any_value(a.v) AS v, any_value(a.n_c) AS n_c, least(3, any_value(a.n_c) - 1) AS k,
    list_sort(list(abs(a.v - b.v)))[CAST(least(3, any_value(a.n_c) - 1) AS INT)] AS r
  FROM kn a JOIN kn b ON a.feature = b.feature AND a.label = b.label AND a.key <> b.key GROUP BY a.feature, a.key, a.label),
kn_m AS (SELECT a.feature, a.key, a.label, any_value(a.n_c) AS n_c, any_value(a.k) AS k, count(*) AS m
  FROM kn_r a JOIN kn b ON a.feature = b.feature AND abs(a.v - b.v) <= greatest(a.r - 1, 0) GROUP BY a.feature, a.key, a.label),
terms AS (SELECT feature, {psi('count(*) OVER (PARTITION BY feature)')} AS psi_n, {psi('k')} AS psi_k, {psi('n_c')} AS psi_c, {psi('m')} AS psi_m
  FROM kn_m)"""


def quantile_ctes(features) -> str:
    """M5 / M6: medians of the given values; centre and interquartile range of the imputed ones."""
    return f"""
q_long AS (SELECT ident, session_id, feature, x FROM session_features UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(features)}))),
medians AS (SELECT feature, quantile_cont(CAST(x AS DOUBLE), 0.5) AS median, count(*) - count(x) AS missing FROM q_long GROUP BY feature HAVING count(x) > 0),
q_filled AS (SELECT l.ident, l.session_id, l.feature, coalesce(CAST(x AS DOUBLE), median, 0.0) AS x FROM q_long l LEFT JOIN medians USING (feature)),
q_range AS (SELECT feature, quantile_cont(x, 0.5) AS centre, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM q_filled GROUP BY feature),
imputed AS (SELECT ident, session_id, feature, x, centre, CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END AS scale FROM q_filled JOIN q_range USING (feature))"""
