"""Weighted scores, normalisation, fleet cut points and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from ..functions.constants import (BEHAVIOURS, CATEGORY_WEIGHTS, HOUR_MULTIPLIERS, SESSION_MULTIPLIERS,
                                   STYLE_QUANTILES)
from ..functions.expressions import _map_sql

GROUP = ["ident", "categoria_strada", "fascia_oraria", "tipo_sessione"]


def behaviour_counts(flagged: DataFrame) -> DataFrame:
    """Events per (vehicle, road category, time band, session type) + readings ``n``."""
    return flagged.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"CAST(sum(f_{b}) AS BIGINT)").alias(f"n_{b}") for b in BEHAVIOURS])


def weighted_scores(counts: DataFrame) -> DataFrame:
    """Count x weight[category][behaviour] x hour multiplier x session multiplier."""
    mh = f"try_element_at({_map_sql(HOUR_MULTIPLIERS)}, fascia_oraria)"
    ms = f"try_element_at({_map_sql(SESSION_MULTIPLIERS)}, tipo_sessione)"
    def weight(b):
        return f"try_element_at({_map_sql({c: float(w[b]) for c, w in CATEGORY_WEIGHTS.items()})}, categoria_strada)"
    return counts.selectExpr(*GROUP, "n", *[f"n_{b} * {weight(b)} * {mh} * {ms} AS s_{b}" for b in BEHAVIOURS])


def behaviour_scores(partials: DataFrame) -> DataFrame:
    """P2 (+N6/N7): one row per gated vehicle; vehicles without an event score 0."""
    return partials.groupBy("ident").agg(
        *[F.sum(f"s_{b}").alias(f"punteggio_{b}") for b in BEHAVIOURS],
        F.expr("CAST(sum(n) AS BIGINT)").alias("tot_record"))


def normalise_scores(scores: DataFrame) -> DataFrame:
    """Every score / gated readings, final score = sum of the 7 normalised scores."""
    norms = [f"punteggio_{b} / tot_record" for b in BEHAVIOURS]
    return scores.selectExpr("*", *[f"{e} AS punteggio_{b}_norm" for e, b in zip(norms, BEHAVIOURS)],
                             f"{' + '.join(norms)} AS punteggio_finale")


def style_cutpoints(scored: DataFrame, quantiles=STYLE_QUANTILES) -> DataFrame:
    """P5: exact fleet quantiles (linear interpolation) of the final score; one row (nulls without scores)."""
    q = exact_quantiles(scored, [], "punteggio_finale", {"q1": quantiles[0], "q2": quantiles[1]})
    return q.agg(F.max("q1").alias("q1"), F.max("q2").alias("q2"))


def assign_style(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """<= q1 -> 0 (prudent), <= q2 -> 1 (normal), else 2 (aggressive).

    ``cuts`` is a global aggregate, exactly one row, so broadcasting it is
    bounded; the join is a lookup on a constant key, not a pairing.
    """
    j = scored.withColumn("_k", F.lit(0)).join(F.broadcast(cuts.withColumn("_k", F.lit(0))), "_k")
    label = (F.when(F.col("punteggio_finale") <= F.col("q1"), 0)
              .when(F.col("punteggio_finale") <= F.col("q2"), 1).otherwise(2))
    return j.withColumn("stile_guida", label.cast("int")).drop("_k")
