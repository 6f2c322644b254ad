"""Stateful streams of the scoring job (J2) and the fuel job (J5): one state per vehicle.

Readings may arrive in any order. A reading waits in its vehicle's state until the watermark has passed it; then the vehicle's
waiting readings are taken in (timestamp, id) order, so every arrival order within the watermark gives what the batch job gives.
A vehicle's state holds the waiting readings of one watermark delay and a fixed-size carry (previous reading, session
number, open session's totals, smoothed value); a session of any length costs no more than its (road category, time band) pairs.

Rules: a reading at or before a time already taken is late and dropped; readings without a vehicle or a time are dropped; a null
id sorts first and does not count as a record, as in the batch jobs; readings of equal time and id keep an arbitrary order. State and
outputs are recovered from the query's checkpoint when executors or the driver are lost.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import BEHAVIOURS, EWM_SPAN, SCORING_GAP_SECONDS
from ..functions.expressions import road_category, session_type, time_band
from ..operators.behaviour import behaviour_conditions
from ..operators.fuel import fuel_input
from ..operators.scoring import GROUP
from ..operators.sessions import valid_sessions
from ..plans.driving_style import ScoringStages, scoring_input

NO_ID = -2**63
WITH_PREVIOUS = ("fluttuazioni_brusche", "sterzate_forti")       # need the vehicle's previous reading
Step = Callable[[dict, pd.DataFrame, int], tuple[pd.DataFrame, int | None]]


def _pack(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def _taken_in_order(readings: DataFrame, columns: list, watermark: str, output: str, step: Step) -> DataFrame:
    """Feed each vehicle's readings to ``step`` in (timestamp, id) order as the watermark passes them.

    ``step(carry, rows, watermark)`` changes the carry (a JSON object) in place and returns the rows to emit and the time at
    which it wants to be called again without readings (None: never). Times are microseconds.
    """
    rows = (readings.withColumn("event_time", F.col("timestamp").cast("timestamp"))
            .where(F.col("event_time").isNotNull() & F.col("ident").isNotNull())
            .withWatermark("event_time", watermark)
            .select("ident", "event_time", F.unix_micros("event_time").alias("t"),
                    F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), *columns))

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, text = state.get if state.exists else (None, '{"done": null}')
        carry = json.loads(text)
        found = [] if state.hasTimedOut else [f.drop(columns=["ident", "event_time"]) for f in frames]
        if carry["done"] is not None:
            found = [f[f["t"] > carry["done"]] for f in found]
        if waiting is not None:
            found.insert(0, pa.ipc.open_stream(bytes(waiting)).read_pandas())
        passed = state.getCurrentWatermarkMs() * 1000
        found = [f for f in found if len(f)]
        due = None
        if found:
            every = pd.concat(found, ignore_index=True).sort_values(["t", "id"], kind="stable", ignore_index=True)
            ready, rest = every[every["t"] <= passed], every[every["t"] > passed]
            if len(rest):
                due = int(rest["t"].iloc[0])
            waiting = _pack(rest) if len(rest) else None
        else:
            ready, waiting = None, None
        out, again = step(carry, ready, passed)
        if ready is not None and len(ready):
            carry["done"] = int(ready["t"].iloc[-1])
        state.update((waiting, json.dumps(carry)))
        due = min((x for x in (due, again) if x is not None), default=None)
        if due is not None:
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        if len(out):
            out.insert(0, "ident", key[0])
            yield out

    return rows.groupBy("ident").applyInPandasWithState(
        take, f"ident string, {output}", "waiting binary, carry string", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- J2

COUNTS = ["n", *[f"n_{b}" for b in BEHAVIOURS]]
CLOSED = ["session_id", "first", "last", "distanza_km", "num_record", "categoria_strada", "fascia_oraria", *COUNTS]


def _close(carry: dict) -> list[list]:
    s = carry.pop("open")
    low, high = s["low"], s["high"]
    distance = high - low if low is not None and high > low else 0.0
    return [[carry["session"], s["first"], s["last"], distance, s["records"], *json.loads(place), *counts]
            for place, counts in sorted(s["places"].items())]


def _session_step(gap: int) -> Step:
    """Sessions split at gaps over ``gap`` microseconds, counted per road category and time band; emitted when closed."""
    def step(carry: dict, rows: pd.DataFrame | None, passed: int):
        out: list[list] = []
        if rows is not None and len(rows):
            before = carry.get("previous")                        # [t, speed, direction]
            prev = rows[["t", "position_speed", "position_direction"]].shift()
            if before is not None:
                prev.iloc[0] = before
            diff = rows["t"] - prev["t"]
            rows = rows.assign(
                new=diff > gap,
                # a comparison with a missing previous reading is false
                f_fluttuazioni_brusche=(((rows["position_speed"] - prev["position_speed"]).abs() > 30) & (diff <= 10_000_000)).astype("int64"),
                f_sterzate_forti=(((rows["position_direction"] - prev["position_direction"]).abs() > 45) & (diff <= 5_000_000)).astype("int64"))
            rows["run"] = rows["new"].cumsum()
            for run, part in rows.groupby("run", sort=True):
                if part["new"].iloc[0] and "open" in carry:       # else the watermark has closed it
                    out += _close(carry)
                    carry["session"] += 1
                if "open" not in carry:
                    carry.setdefault("session", 0)
                    carry["open"] = {"first": int(part["t"].iloc[0]), "low": None, "high": None, "records": 0, "places": {}}
                s = carry["open"]
                s["last"] = int(part["t"].iloc[-1])
                s["records"] += int((part["id"] != NO_ID).sum())
                km = part["vehicle_mileage"].dropna()
                if len(km):
                    s["low"] = float(km.min()) if s["low"] is None else min(s["low"], float(km.min()))
                    s["high"] = float(km.max()) if s["high"] is None else max(s["high"], float(km.max()))
                sums = part.assign(f_n=1).groupby(["categoria_strada", "fascia_oraria"])[["f_n", *[f"f_{b}" for b in BEHAVIOURS]]].sum()
                for place, counts in zip(sums.index, sums.to_numpy()):
                    old = s["places"].get(json.dumps(place), [0] * len(COUNTS))
                    s["places"][json.dumps(place)] = [a + int(b) for a, b in zip(old, counts)]
            tail = rows.iloc[-1]
            carry["previous"] = [int(tail["t"]), float(tail["position_speed"]), float(tail["position_direction"])]
        due = None
        if "open" in carry:
            due = carry["open"]["last"] + gap
            if due <= passed:                 # every later reading opens a new session
                out += _close(carry)
                carry["session"] += 1
                due = None
        return pd.DataFrame(out, columns=CLOSED), due
    return step


def stream_session_counts(readings: DataFrame, watermark: str = "30 minutes", gap_seconds: float = SCORING_GAP_SECONDS) -> DataFrame:
    """W1-W5, B1-B7, A1 on a stream: one row per closed session, road category and time band.

    Columns: ident, session_id, inizio, fine, distanza_km, num_record, durata_minuti (all of the session), categoria_strada,
    fascia_oraria, tipo_sessione, n and n_<behaviour> (of the group). Append mode.
    """
    conditions = behaviour_conditions()
    columns = ["position_speed", "position_direction", "vehicle_mileage", road_category("tipo_strada").alias("categoria_strada"),
               time_band(F.hour("timestamp")).alias("fascia_oraria"),
               *[F.expr(f"CAST(coalesce({conditions[b]}, false) AS BIGINT)").alias(f"f_{b}") for b in BEHAVIOURS if b not in WITH_PREVIOUS]]
    output = ("session_id bigint, first bigint, last bigint, distanza_km double, num_record bigint, categoria_strada string, "
              "fascia_oraria string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    closed = _taken_in_order(scoring_input(readings), columns, watermark, output, _session_step(round(gap_seconds * 1e6)))
    return (closed.withColumn("durata_minuti", (F.col("last") / F.lit(1e6) - F.col("first") / F.lit(1e6)) / F.lit(60.0))
            .select("ident", "session_id", F.timestamp_micros("first").cast("timestamp_ntz").alias("inizio"),
                    F.timestamp_micros("last").cast("timestamp_ntz").alias("fine"), "distanza_km", "num_record", "durata_minuti",
                    "categoria_strada", "fascia_oraria", session_type("durata_minuti").alias("tipo_sessione"), *COUNTS))


def stages_of_closed(closed: DataFrame) -> ScoringStages:
    """J2 from the table that ``stream_session_counts`` appends to: summaries, event counts, scores, cut points and labels."""
    session = ["ident", "session_id", "inizio", "fine", "distanza_km", "num_record", "durata_minuti"]
    summary = closed.select(*session).dropDuplicates(["ident", "session_id"])
    counts = closed.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return ScoringStages(None, None, summary, valid_sessions(summary), counts)


# ---------------------------------------------------------------- J5

def _fuel_step(alpha: float) -> Step:
    """Positive counter deltas and their exponentially weighted mean."""
    def step(carry: dict, rows: pd.DataFrame | None, passed: int):
        out = []
        if rows is not None:
            last, mean = carry.get("counter"), carry.get("mean")
            for t, row_id, value in zip(rows["t"].tolist(), rows["id"].tolist(), rows["can_fuel_consumed"].tolist()):
                if last is not None and value - last > 0:
                    delta = value - last
                    mean = delta if mean is None else (1.0 - alpha) * mean + alpha * delta
                    out.append((row_id, t, delta, mean))
                last = value
            carry["counter"], carry["mean"] = last, mean
        return pd.DataFrame(out, columns=["id", "t", "fuel_delta", "fuel_delta_smooth"]), None
    return step


def stream_fuel_series(readings: DataFrame, watermark: str = "30 minutes", span: int = EWM_SPAN, dashboard: bool = False) -> DataFrame:
    """W7, F8, W8 on a stream (ident, id, timestamp, fuel_delta, fuel_delta_smooth), append mode."""
    output = "id bigint, t bigint, fuel_delta double, fuel_delta_smooth double"
    series = _taken_in_order(fuel_input(readings, dashboard), ["can_fuel_consumed"], watermark, output, _fuel_step(2.0 / (span + 1)))
    return series.select("ident", F.expr(f"nullif(id, {NO_ID + 1} - 1)").alias("id"),
                         F.timestamp_micros("t").cast("timestamp_ntz").alias("timestamp"), "fuel_delta", "fuel_delta_smooth")


def start(stream: DataFrame, sink_path: str, checkpoint_path: str, **trigger):
    """Append a stream of this module to a Parquet table (exactly once, by the checkpoint)."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(**trigger) if trigger else writer).start()
