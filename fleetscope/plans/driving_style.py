"""Sessionize, detect behaviour, score and label every vehicle of the fleet.

Plan shape: one exchange of the readings on (ident, time chunk) serves every
per-vehicle scan; everything after is partial aggregation into per-vehicle
rows. See ``operators.ordered`` for the chunked scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BEHAVIOURS
from ..operators import behaviour, scoring, sessions
from ..session import materialize
from ..sources.telemetry import SCORING_COLUMNS, gate_condition, quality_gate, update_by_key


@dataclass
class ScoringStages:
    gated: DataFrame
    rows: DataFrame          # sessionized + enriched + flagged readings
    summary: DataFrame       # all sessions (A1)
    valid: DataFrame         # valid sessions (F5)
    counts: DataFrame        # events per vehicle x category x band x type

    @cached_property
    def scores(self) -> DataFrame:
        """One row per vehicle (P1-P4), read by the cut points, the labels and the reports: stored once, when first asked for."""
        return materialize(scoring.normalise_scores(scoring.behaviour_scores(scoring.weighted_scores(self.counts))))

    @cached_property
    def cuts(self) -> DataFrame:
        return scoring.style_cutpoints(self.scores)

    @cached_property
    def styles(self) -> DataFrame:
        """The result of ``driving_style``."""
        labelled = scoring.assign_style(self.scores, self.cuts)
        stats = sessions.vehicle_session_stats(self.valid)
        stat_cols = ["num_sessioni", "durata_media", "durata_totale", "distanza_totale"]
        return (labelled.join(stats, "ident", "left")
                .fillna(0, subset=stat_cols)
                .select("ident", *[f"punteggio_{b}" for b in BEHAVIOURS], "tot_record",
                        *[f"punteggio_{b}_norm" for b in BEHAVIOURS], "punteggio_finale",
                        "stile_guida", *stat_cols))


def scoring_input(telemetry: DataFrame) -> DataFrame:
    """S1 + F1 for J2. Rows without a vehicle id cannot be grouped and are dropped."""
    return quality_gate(telemetry, "can_vehicle_mileage").select(*SCORING_COLUMNS).filter(
        F.col("ident").isNotNull())


def stage_fleet(telemetry: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Readings that pass the J2 gate (``_g2``) or the J3 gate (``_g3``), staged once
    on (ident, time chunk) for both jobs."""
    g2 = gate_condition("can_vehicle_mileage")
    g3 = gate_condition("vehicle_mileage")
    df = (telemetry.filter(F.col("ident").isNotNull() & (g2 | g3))
                   .select(*SCORING_COLUMNS, g2.alias("_g2"), g3.alias("_g3")))
    return sessions.stage_readings(df, chunk_seconds)


def scoring_stages(telemetry: DataFrame | None, chunk_seconds: int = 3600, direction_wrap: bool = False,
                   staged: DataFrame | None = None) -> ScoringStages:
    """J2 on raw telemetry, or on readings already staged by ``stage_fleet``."""
    if staged is None:
        gated = sessions.stage_readings(scoring_input(telemetry), chunk_seconds)
    else:   # a filter and a projection keep the staged partitioning and order
        gated = staged.filter(F.col("_g2")).select(*SCORING_COLUMNS, "_chunk")
    # sessionized readings feed three branches (summary, enrichment, counts):
    # stored once, in place, instead of re-running the carry scans per branch
    sess = materialize(sessions.sessionize_scoring(gated, chunk_seconds=chunk_seconds), keep_partitioning=True)
    summary = sessions.session_summary(sess)
    valid = sessions.valid_sessions(summary)
    rows = behaviour.behaviour_flags(sessions.enrich_rows(sess, summary), direction_wrap)
    counts = scoring.behaviour_counts(rows)
    return ScoringStages(gated, rows, summary, valid, counts)


def driving_style(telemetry: DataFrame, **kw) -> DataFrame:
    """One row per gated vehicle: 7 scores, readings, normalised scores, final score,
    label 0/1/2 and valid-session statistics."""
    return scoring_stages(telemetry, **kw).styles


def label_telemetry(telemetry: DataFrame, styles: DataFrame) -> DataFrame:
    """Write the vehicle label onto *all* its readings (also gate-rejected ones)."""
    return update_by_key(telemetry, styles.select("ident", "stile_guida"), "ident", ["stile_guida"])
