"""Fixed values that must equal the studied application's for equal results.

FIXED VALUES — the tables below are data, not logic: default speed per OSM
``highway`` type, road type -> road category, behaviour weights per road
category, time-band and session-type multipliers, the behaviour names, the 25
model features and the two fuel feature sets. Keep them in this order.
"""

# ---- FIXED VALUES: default speed limit (km/h) per OSM highway type; -1 = none
DEFAULT_SPEEDS = {
    "motorway": 130,
    "motorway_link": 90,
    "trunk": 110,
    "trunk_link": 90,
    "primary": 90,
    "primary_link": 70,
    "secondary": 70,
    "secondary_link": 60,
    "tertiary": 50,
    "tertiary_link": 50,
    "residential": 50,
    "living_street": 30,
    "service": 30,
    "unclassified": -1,
    "busway": 50,
    "bus_stop": -1,
    "construction": -1,
    "corridor": -1,
    "cycleway": 20,
    "emergency_bay": -1,
    "footway": -1,
    "path": -1,
    "pedestrian": 10,
    "platform": -1,
    "proposed": -1,
    "razed": -1,
    "rest_area": 10,
    "road": 50,
    "services": 30,
    "steps": -1,
    "track": 30,
}

# ---- FIXED VALUES: OSM highway type -> road category (others: "undefined")
ROAD_CATEGORIES = {
    "motorway": "autostrada",
    "motorway_link": "autostrada",
    "trunk": "autostrada",
    "trunk_link": "autostrada",
    "primary": "extraurbana",
    "primary_link": "extraurbana",
    "secondary": "extraurbana",
    "secondary_link": "extraurbana",
    "tertiary": "urbana_secondaria",
    "tertiary_link": "urbana_secondaria",
    "road": "urbana_secondaria",
    "residential": "urbana",
    "living_street": "urbana",
    "service": "urbana",
    "services": "urbana",
    "busway": "urbana",
    "pedestrian": "urbana",
    "rest_area": "urbana",
    "track": "urbana",
    "cycleway": "urbana",
}
UNDEFINED_CATEGORY = "undefined"

# ---- FIXED VALUES: behaviour names, in scoring order
BEHAVIOURS = [
    "superamenti_limite",
    "accelerazioni_brusche",
    "frenate_brusche",
    "fluttuazioni_brusche",
    "sterzate_forti",
    "uso_alto_rpm",
    "motore_acceso_fermo",
]

# ---- FIXED VALUES: weight per road category and behaviour
CATEGORY_WEIGHTS = {
    "autostrada": {
        "superamenti_limite": 3,
        "frenate_brusche": 5,
        "accelerazioni_brusche": 2,
        "fluttuazioni_brusche": 4,
        "sterzate_forti": 5,
        "uso_alto_rpm": 1,
        "motore_acceso_fermo": 2,
    },
    "extraurbana": {
        "superamenti_limite": 4,
        "frenate_brusche": 4,
        "accelerazioni_brusche": 3,
        "fluttuazioni_brusche": 3,
        "sterzate_forti": 4,
        "uso_alto_rpm": 2,
        "motore_acceso_fermo": 2,
    },
    "urbana_secondaria": {
        "superamenti_limite": 5,
        "frenate_brusche": 3,
        "accelerazioni_brusche": 4,
        "fluttuazioni_brusche": 3,
        "sterzate_forti": 3,
        "uso_alto_rpm": 3,
        "motore_acceso_fermo": 3,
    },
    "urbana": {
        "superamenti_limite": 6,
        "frenate_brusche": 2,
        "accelerazioni_brusche": 5,
        "fluttuazioni_brusche": 2,
        "sterzate_forti": 2,
        "uso_alto_rpm": 4,
        "motore_acceso_fermo": 4,
    },
    "undefined": {
        "superamenti_limite": 5,
        "frenate_brusche": 4,
        "accelerazioni_brusche": 3,
        "fluttuazioni_brusche": 3,
        "sterzate_forti": 2,
        "uso_alto_rpm": 2,
        "motore_acceso_fermo": 1,
    },
}

# ---- FIXED VALUES: time band multipliers (notte 22-6, alba 6-8, giorno 8-18, sera 18-22)
HOUR_MULTIPLIERS = {
    "notte": 1.3,
    "alba": 1.1,
    "giorno": 1.0,
    "sera": 1.1,
}

# ---- FIXED VALUES: session type multipliers (breve <30 min, normale <=120, lunga >120)
SESSION_MULTIPLIERS = {
    "breve": 1.1,
    "normale": 1.0,
    "lunga": 1.2,
}

# ---- FIXED VALUES: the 25 session features, in model order
SESSION_FEATURES = [
    "session_duration", "total_points", "avg_speed", "max_speed", "speed_std",
    "speed_95_percentile", "time_above_50", "avg_rpm", "max_rpm", "rpm_std",
    "high_rpm_ratio", "avg_acceleration", "avg_deceleration", "harsh_acceleration_count",
    "harsh_braking_count", "brake_usage_ratio", "avg_brake_intensity", "avg_throttle",
    "max_throttle", "aggressive_throttle_ratio", "fuel_efficiency_score",
    "avg_speed_vs_limit", "speeding_ratio", "speed_variability", "rpm_variability",
]

# ---- FIXED VALUES: fuel model feature sets (script set and dashboard set)
FUEL_FEATURES_SCRIPT = [
    "battery_voltage",
    "can_engine_rpm",
    "can_pedal_brake_status",
    "can_throttle_pedal_level",
    "position_altitude",
    "position_direction",
    "position_speed",
    "vehicle_mileage",
]
FUEL_FEATURES_DASHBOARD = [
    "battery_voltage",
    "can_engine_rpm",
    "can_throttle_pedal_level",
    "position_speed",
    "vehicle_mileage",
]

# ---- FIXED VALUES: numeric parameters of the jobs
EARTH_RADIUS_M = 6378137.0          # EPSG:3857 sphere radius
SCORING_GAP_SECONDS = 600           # J2 session split: gap > 10 min
FEATURE_GAP_MINUTES = 30            # J3 session split: gap > 30 min
MIN_SESSION_MINUTES = 5             # J3 valid session: duration >= 5 min
MIN_SESSION_POINTS = 10             # J3 valid session: >= 10 points
SPEED_THRESHOLD = 0                 # J3 valid session: max speed >= 0
STYLE_QUANTILES = (0.33, 0.66)      # J2 cut points
EWM_SPAN = 20                       # J5 smoothing span (alpha = 2 / (span + 1))
