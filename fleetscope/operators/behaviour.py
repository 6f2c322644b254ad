"""Risky-behaviour detection (B1-B7) as integer flag columns on gated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BEHAVIOURS
from ..functions.expressions import road_category


def behaviour_conditions(direction_wrap: bool = False) -> dict[str, str]:
    """B1-B7 as SQL predicates over a gated reading and its previous reading."""
    turn = "abs(position_direction - prev_position_direction)"
    if direction_wrap:   # opt-in: 359 -> 1 counts as 2 degrees
        turn = f"least({turn}, 360 - {turn})"
    return {
        # B1: a NULL road type still counts; only 'unclassified' is excluded
        "superamenti_limite": "limite_velocita > 0 AND NOT (tipo_strada <=> 'unclassified') "
                              "AND position_speed > limite_velocita",
        "accelerazioni_brusche": "can_throttle_pedal_level > 80",
        "frenate_brusche": "can_pedal_brake_status = 1 AND position_speed > 50",
        "fluttuazioni_brusche": "abs(position_speed - prev_position_speed) > 30 AND time_diff <= 10",
        "sterzate_forti": f"{turn} > 45 AND time_diff <= 5",
        "uso_alto_rpm": "can_engine_rpm > 4000",
        "motore_acceso_fermo": "can_engine_rpm > 0 AND position_speed = 0",
    }


def behaviour_flags(rows: DataFrame, direction_wrap: bool = False) -> DataFrame:
    """Adds ``categoria_strada`` and ``f_<behaviour>`` (0/1) for each of B1-B7.

    Expects ``time_diff``, ``prev_position_speed`` and ``prev_position_direction``
    (per-vehicle previous reading across session borders, as W4/W5). A
    comparison with NULL is false, as in the original filters.
    """
    conds = behaviour_conditions(direction_wrap)
    return rows.select("*", road_category("tipo_strada").alias("categoria_strada"),
                       *[F.expr(f"CAST(coalesce({conds[b]}, false) AS INT)").alias(f"f_{b}") for b in BEHAVIOURS])
