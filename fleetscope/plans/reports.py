"""Report tables behind the printed summaries and dashboard charts.

All are aggregates of the job outputs; a "top k" or "first n" is an ordered
limit (TakeOrderedAndProject), never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SESSION_FEATURES
from ..operators.quantiles import exact_quantiles
from ..sources.versioned import VersionedTable


def fleet_report(valid: DataFrame, styles: DataFrame, cuts: DataFrame) -> DataFrame:
    """R1 + A3: valid sessions, mean minutes and km, sessions per vehicle, mean score, q1, q2."""
    s = valid.agg(F.count(F.lit(1)).alias("sessioni_valide"), F.avg("durata_minuti").alias("durata_media"),
                  F.avg("distanza_km").alias("distanza_media"),
                  F.count_distinct("ident").alias("_veicoli"))
    s = s.withColumn("sessioni_per_veicolo", F.col("sessioni_valide") / F.col("_veicoli")).drop("_veicoli")
    p = styles.agg(F.avg("punteggio_finale").alias("punteggio_medio"))
    # three one-row aggregates side by side (each exactly one row)
    k = F.lit(0)
    return (s.withColumn("_k", k).join(p.withColumn("_k", k), "_k").join(cuts.withColumn("_k", k), "_k")
             .drop("_k"))


def share_distribution(rows: DataFrame, col: str) -> DataFrame:
    """Rows and percent of all rows per value of ``col``."""
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy())   # over the (few) groups, not the rows
    return counts.withColumn("percentuale", F.col("records") / total * 100)


def vehicle_style_distribution(styles: DataFrame) -> DataFrame:
    """Vehicles and percent for labels 0, 1, 2 (empty classes included)."""
    one = styles.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(F.col("stile_guida") == i).alias(f"_c{i}") for i in range(3)])
    stacked = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("stile_guida"), F.col(f"_c{i}").alias("veicoli")) for i in range(3)])).alias("s"))
    return stacked.select("s.stile_guida", "s.veicoli",
                          (F.col("s.veicoli") / F.col("_n") * 100).alias("percentuale"))


def risk_event_totals(rows: DataFrame) -> DataFrame:
    """Speeding, harsh braking and harsh throttle events."""
    return rows.agg(F.sum("f_superamenti_limite").cast("long").alias("superamenti_limite"),
                    F.sum("f_frenate_brusche").cast("long").alias("frenate_brusche"),
                    F.sum("f_accelerazioni_brusche").cast("long").alias("accelerazioni_brusche"))


def top_aggressive(styles: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest final scores (ties by vehicle id) with session stats."""
    return (styles.orderBy(F.desc("punteggio_finale"), F.asc("ident")).limit(k)
                  .select("ident", "punteggio_finale", "num_sessioni", "durata_totale"))


def session_statistics(sessions: DataFrame) -> DataFrame:
    """R7 + A8: sessions, vehicles, styles, mean minutes and speed, points, longest, shortest."""
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_distinct("ident").alias("unique_vehicles"),
        F.count_distinct("stile_guida").alias("unique_driving_styles"),
        F.bround(F.avg("session_duration"), 2).alias("avg_session_duration"),
        F.bround(F.avg("avg_speed"), 2).alias("avg_speed_overall"),
        F.bround(F.avg("total_points"), 0).alias("avg_points_per_session"),
        F.bround(F.max("session_duration"), 2).alias("longest_session_minutes"),
        F.bround(F.min("session_duration"), 2).alias("shortest_session_minutes"))


def style_distribution(sessions: DataFrame) -> DataFrame:
    """Sessions per label and percent (2 places), most frequent first."""
    counts = sessions.groupBy("stile_guida").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (counts.withColumn("percentage", F.bround(F.col("count") / total * 100, 2))
                  .orderBy(F.desc("count"), F.asc("stile_guida")))


def speed_box_by_style(sessions: DataFrame) -> DataFrame:
    """Box-plot numbers of ``avg_speed`` per label."""
    x = F.col("avg_speed")
    ends = sessions.groupBy("stile_guida").agg(F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(sessions, ["stile_guida"], "avg_speed", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ends.join(q, "stile_guida", "left").select("stile_guida", "min", "q1", "median", "q3", "max")


def session_preview(sessions: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` sessions in (vehicle, session) order, display columns."""
    return (sessions.orderBy("ident", "session_id").limit(n)
                    .select("ident", "session_id", "avg_speed", "max_speed", "avg_rpm", "session_duration",
                            "total_points", "stile_guida"))


def session_label(sessions: DataFrame) -> DataFrame:
    """The session label (mode of the readings' labels)."""
    return sessions.select("ident", "session_id", "stile_guida")


FEATURES = SESSION_FEATURES


def publish(reports: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, int]:
    """Every report as the next version of its own table under ``root`` (``parquet``, ``csv`` or ``json``); returns the versions.

    A report is replaced as a whole; readers of the former version keep it.
    """
    versions = {}
    for name, df in reports.items():
        place = f"{root.rstrip('/')}/{name}"
        try:
            table = VersionedTable.open(df.sparkSession, place).replace(df)
        except LookupError:
            table = VersionedTable.create(df, place, df.columns[0], buckets=1, fmt=fmt)
        versions[name] = table.version
    return versions
