"""Median imputation (M5) and robust scaling (M6) with exact quantiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def feature_quantiles(df: DataFrame, features: list[str], probs: dict[str, float], fill: dict | None = None) -> DataFrame:
    """One row per feature (those without a value are missing): exact quantiles of its values, nulls and NaN left out or filled."""
    values = [f"'{f}', coalesce(nanvl(CAST(`{f}` AS DOUBLE), NULL), {repr(float(fill[f])) + 'D' if fill and fill.get(f) is not None else 'NULL'})" for f in features]
    long = df.selectExpr(f"stack({len(features)}, {', '.join(values)}) AS (feature, x)")
    return exact_quantiles(long, ["feature"], "x", probs)


@dataclass
class Preparation:
    """Fitted medians (of the given values), centres and scales (of the imputed values)."""
    median: dict
    centre: dict
    scale: dict

    def imputed(self, feature: str):
        return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(None).cast("double")), F.lit(float(self.median.get(feature) or 0.0)))

    def scaled(self, feature: str):
        return (self.imputed(feature) - F.lit(float(self.centre.get(feature, 0.0)))) / F.lit(float(self.scale.get(feature, 1.0)))

    def transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        """``df`` with ``_i_<feature>`` (imputed) columns and the vector ``features`` of the scaled values."""
        from pyspark.ml.functions import array_to_vector
        return df.select("*", *[self.imputed(f).alias(f"_i_{f}") for f in features],
                         array_to_vector(F.array(*[self.scaled(f) for f in features])).alias("features"))


def fit_preparation(train: DataFrame, features: list[str]) -> Preparation:
    """A feature without any value is imputed with 0; an interquartile range of 0 scales by 1. Three numbers per feature reach the driver."""
    median = {r["feature"]: r["m"] for r in feature_quantiles(train, features, {"m": 0.5}).collect()}
    filled = {f: median.get(f, 0.0) for f in features}
    rows = feature_quantiles(train, features, {"lo": 0.25, "m": 0.5, "hi": 0.75}, filled).collect()
    return Preparation(filled, {r["feature"]: r["m"] for r in rows}, {r["feature"]: (r["hi"] - r["lo"]) or 1.0 for r in rows})
