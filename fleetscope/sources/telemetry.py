"""Telemetry and road inputs, projections, quality gates and write-back.

The real inputs are a telemetry table (one row per sensor reading) and a road
table (OSM polylines). The test tables ship neither, so ``telemetry_from_events``
and ``roads_from_part`` derive them deterministically from ``events`` and
``part``; the same derivation exists as SQL text in ``plans.sql`` for the
independent engine. Everything downstream only needs the column contract in
``schemas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("ident", T.StringType()),
    T.StructField("battery_voltage", T.DoubleType()),
    T.StructField("can_engine_rpm", T.IntegerType()),
    T.StructField("can_pedal_brake_status", T.IntegerType()),
    T.StructField("can_throttle_pedal_level", T.IntegerType()),
    T.StructField("engine_ignition_status", T.BooleanType()),
    T.StructField("movement_status", T.BooleanType()),
    T.StructField("position_altitude", T.IntegerType()),
    T.StructField("position_direction", T.IntegerType()),
    T.StructField("position_latitude", T.DoubleType()),
    T.StructField("position_longitude", T.DoubleType()),
    T.StructField("position_satellites", T.IntegerType()),
    T.StructField("position_speed", T.DoubleType()),
    T.StructField("vehicle_mileage", T.DoubleType()),
    T.StructField("can_vehicle_mileage", T.DoubleType()),
    T.StructField("din_1", T.BooleanType()),
    T.StructField("can_fuel_consumed", T.DoubleType()),
    T.StructField("limite_velocita", T.IntegerType()),
    T.StructField("tipo_strada", T.StringType()),
])

ROAD_SCHEMA = T.StructType([
    T.StructField("osm_id", T.LongType()),
    T.StructField("highway", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("way", T.ArrayType(T.StructType([
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
])

EVENT_CHUNK = 65_536     # event ids whose running sums one task forms per user

# Column sets of the two scans.
SCORING_COLUMNS = [
    "id", "timestamp", "ident", "battery_voltage", "can_engine_rpm", "can_pedal_brake_status",
    "can_throttle_pedal_level", "engine_ignition_status", "movement_status", "position_altitude",
    "position_direction", "position_latitude", "position_longitude", "position_satellites",
    "position_speed", "vehicle_mileage", "din_1", "limite_velocita", "tipo_strada",
]
FEATURE_COLUMNS = SCORING_COLUMNS + ["stile_guida"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Deterministic telemetry view over ``events`` (contract: TELEMETRY_SCHEMA).

    Written as SQL expressions: one projection per step instead of hundreds of
    column-builder calls.
    """
    from pyspark.sql import Window
    e = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        "CASE WHEN event_id * 53 % 61 = 0 THEN 2700 WHEN event_id * 53 % 23 = 0 THEN 700 "
        "WHEN event_id * 53 % 5 = 0 THEN 4 ELSE 20 + event_id * 7919 % 60 END AS gap_s",
        "CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS fuel_step",
        f"event_id DIV {EVENT_CHUNK} AS _chunk")
    # Running sums per user in chunks of event ids: no task holds all events of a user.
    w = Window.partitionBy("user_id", "_chunk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("user_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (e.groupBy("user_id", "_chunk").agg(F.sum("gap_s").alias("t"), F.sum("fuel_step").alias("f"))
              .select("user_id", "_chunk", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                      F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0")))
    g = (e.withColumns({"t_s": F.sum("gap_s").over(w), "fuel_c": F.sum("fuel_step").over(w)})
          .join(carry, ["user_id", "_chunk"], "left")          # events without a user form no series of their own
          .withColumns({"t_s": F.col("t_s") + F.coalesce("t0", F.lit(0)), "fuel_c": F.col("fuel_c") + F.coalesce("f0", F.lit(0))}))
    mileage = "CAST(100000 + user_id * 1000 + t_s / 100.0D AS DOUBLE)"
    return g.selectExpr(
        "event_id AS id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(t_s + user_id * 1777 % 86400 AS DECIMAL(18, 6))) AS timestamp",
        "concat('V', CAST(user_id AS STRING)) AS ident",
        "12 + k / 50.0D AS battery_voltage",
        "CAST(600 + event_id * 104729 % 4400 AS INT) AS can_engine_rpm",
        "CAST(CASE WHEN event_id * 31 % 10 < 2 THEN 1 ELSE 0 END AS INT) AS can_pedal_brake_status",
        "CASE WHEN event_id % 41 = 0 THEN CAST(NULL AS INT) ELSE CAST(event_id * 6151 % 101 AS INT) END AS can_throttle_pedal_level",
        "event_id * 31 % 67 <> 0 AS engine_ignition_status",
        "event_id % 37 <> 0 AS movement_status",
        "CAST(event_id * 17 % 900 AS INT) AS position_altitude",
        "CAST(event_id * 3571 % 361 AS INT) AS position_direction",
        "41 + (event_id * 1009 % 10000) / 10000.0D AS position_latitude",
        "12 + (event_id * 2003 % 9973) / 10000.0D AS position_longitude",
        "CAST(4 + event_id * 13 % 10 AS INT) AS position_satellites",
        "(event_id * 7919 % 1301) / 10.0D AS position_speed",
        f"{mileage} AS vehicle_mileage",
        f"{mileage} AS can_vehicle_mileage",
        "event_id % 29 <> 0 AS din_1",
        "fuel_c / 100.0D AS can_fuel_consumed",
        "CAST(CASE WHEN k % 9 = 0 THEN -1 WHEN k % 9 = 1 THEN NULL WHEN k % 9 < 4 THEN 50 WHEN k % 9 < 7 THEN 90 "
        "ELSE 130 END AS INT) AS limite_velocita",
        "CASE WHEN k % 9 = 0 THEN 'unclassified' WHEN k % 9 = 1 THEN NULL WHEN k % 9 = 2 THEN 'residential' "
        "WHEN k % 9 = 3 THEN 'tertiary' WHEN k % 9 < 7 THEN 'primary' ELSE 'motorway' END AS tipo_strada",
    )


def roads_from_part(part: DataFrame) -> DataFrame:
    """Deterministic road polylines (EPSG:3857) over ``part`` (contract: ROAD_SCHEMA)."""
    import math
    pk = F.col("p_partkey")
    px = F.lit(6378137.0) * F.radians(F.lit(12) + (pk * 1009 % 9973) / F.lit(10000.0))
    py = F.lit(6378137.0) * F.log(F.tan(F.lit(math.pi) / 4 + F.radians(F.lit(41) + (pk * 2003 % 10000) / F.lit(10000.0)) / 2))
    highway = (F.when(pk % 8 == 0, "motorway").when(pk % 8 == 1, "primary").when(pk % 8 == 2, "secondary")
               .when(pk % 8 == 3, "tertiary").when(pk % 8 == 4, "residential").when(pk % 8 == 5, "footway")
               .when(pk % 8 == 6, "bridleway"))
    sz = F.col("p_size") % 6
    maxspeed = (F.when(sz == 0, "50").when(sz == 1, "90 km/h").when(sz == 2, "none")
                .when(sz == 3, "30;50").when(sz == 4, "60 mph"))
    base = part.select(pk.alias("osm_id"), highway.alias("highway"), maxspeed.alias("maxspeed"),
                       px.alias("x0"), py.alias("y0"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, pk = F.col("x0"), F.col("y0"), F.col("osm_id")
    return base.select(
        "osm_id", "highway",
        F.when(F.col("maxspeed").isNotNull(), F.create_map(F.lit("maxspeed"), F.col("maxspeed")))
         .otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        F.array(pt(x0, y0),
                pt(x0 + (pk * 37 % 2001 - 1000), y0 + (pk * 91 % 2001 - 1000)),
                pt(x0 + (pk * 53 % 3001 - 1500), y0 + (pk * 71 % 3001 - 1500))).alias("way"))


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              fetch_size: int = 10000, options: dict | None = None) -> DataFrame:
    """Read a relational table (or a caller query) in parallel.

    The original fetched one result set in pages of ``fetch_size`` rows on one
    connection; here ``partition_column`` with bounds splits the read into
    ``num_partitions`` range queries run by the executors, each streaming with
    the same fetch size. Credentials come from ``options`` (never from code).
    """
    made = jdbc_options(url, table, query, partition_column, lower_bound, upper_bound, num_partitions, fetch_size)
    return spark.read.format("jdbc").options(**made, **(options or {})).load()


def jdbc_options(url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000) -> dict[str, str]:
    """Reader options of ``read_jdbc``. A query is passed as a subquery table, which Spark can partition."""
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    out = {"url": url, "fetchsize": str(fetch_size), "dbtable": table if table else f"({query}) AS q"}
    if partition_column:
        bounds = {"lowerBound": lower_bound, "upperBound": upper_bound, "numPartitions": num_partitions}
        if None in bounds.values():
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        out |= {"partitionColumn": partition_column, **{k: str(v) for k, v in bounds.items()}}
    return out


def with_parsed_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """A text timestamp becomes TIMESTAMP_NTZ; typed timestamps become NTZ wall time."""
    t = df.schema[col].dataType
    if isinstance(t, T.StringType):
        return df.withColumn(col, F.to_timestamp_ntz(F.col(col)))
    if isinstance(t, T.TimestampType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df


def load_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(read_table(spark, sf_dir, "events"))


def load_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads_from_part(read_table(spark, sf_dir, "part"))


# ---------------------------------------------------------------- scans / gates

def gate_condition(mileage_col: str = "can_vehicle_mileage", altitude: bool = True,
                   direction: bool = True) -> Column:
    """Quality gate; BETWEEN is inclusive and NULL fails every comparison."""
    parts = ["din_1 = true", "engine_ignition_status = true", "position_speed > 0", "movement_status = true",
             "can_engine_rpm BETWEEN 1 AND 8000", "position_latitude BETWEEN -90 AND 90",
             "position_longitude BETWEEN -180 AND 180"]
    if altitude:
        parts.append("position_altitude BETWEEN -500 AND 10000")
    if direction:
        parts.append("position_direction BETWEEN 1 AND 359")
    parts += ["position_satellites > 4", f"`{mileage_col}` < 2000000"]
    return F.expr(" AND ".join(parts))


def quality_gate(df: DataFrame, mileage_col: str = "can_vehicle_mileage", altitude: bool = True,
                 direction: bool = True) -> DataFrame:
    """plain column predicates, so they reach the parquet scan."""
    return df.filter(gate_condition(mileage_col, altitude, direction))


def scan_telemetry(df: DataFrame, columns: list[str] | None = None, gated: bool = True,
                   mileage_col: str = "can_vehicle_mileage") -> DataFrame:
    """Explicit projection (+ gate). No global sort: order lives in the windows."""
    cols = columns or SCORING_COLUMNS
    df = with_parsed_timestamp(df)
    out = quality_gate(df, mileage_col) if gated else df
    return out.select(*cols)


def scan_vehicle(df: DataFrame, ident: str) -> DataFrame:
    """One vehicle, as a literal predicate (never SQL text)."""
    return df.filter(F.col("ident") == F.lit(ident))


def scan_custom_query(spark: SparkSession, query: str) -> DataFrame:
    """Any caller-supplied SQL over registered views."""
    return spark.sql(query)


def scan_roads(roads: DataFrame) -> DataFrame:
    """Road type present and a non-empty polyline."""
    return roads.filter(F.col("highway").isNotNull() & F.col("way").isNotNull() & (F.size("way") > 0))


def scan_points(df: DataFrame) -> DataFrame:
    """Row key and WGS84 coordinates, both present."""
    return (df.select("id", "position_latitude", "position_longitude")
              .filter(F.col("position_latitude").isNotNull() & F.col("position_longitude").isNotNull()))


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each missing column as typed NULL; existing columns are kept."""
    for name, dtype in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def update_by_key(target: DataFrame, updates: DataFrame, key: str | list[str],
                  columns: list[str]) -> DataFrame:
    """UPDATE target SET cols = updates.cols WHERE key matches.

    A left join on the key, then ``matched ? new : old``. The updates side is a
    per-key table; AQE turns the join into a broadcast when its runtime size is
    under the threshold and keeps a (skew-split) sort-merge join otherwise.
    Repeated keys in ``updates`` never multiply target rows: the row with the
    largest new values (compared column by column) is applied.
    """
    keys = [key] if isinstance(key, str) else list(key)
    target = ensure_columns(target, {c: updates.schema[c].dataType.simpleString() for c in columns})
    one = updates.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("__new"))
    upd = one.select(*keys, *[F.col(f"__new.{c}").alias(f"__new_{c}") for c in columns],
                     F.lit(True).alias("__matched"))
    joined = target.join(upd, keys, "left")
    out = joined
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__matched"), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns)
