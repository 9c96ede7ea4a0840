"""Skewness and log1p of skewed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import adjusted_skew
from gravitas.operators.distributions import per_feature


def skewness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-adjusted skewness of the columns without negative values."""
    table = per_feature(df, cols, lambda c: {"lowest": F.min(c).cast("double"), "skewness": adjusted_skew(F.col(c))})
    return table.where("lowest >= 0").select("feature", "skewness")


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = preset.SKEW_THRESHOLD) -> list[str]:
    found = {r["feature"] for r in skewness(df, cols).where(F.abs("skewness") > threshold).collect()}
    return [c for c in cols if c in found]


def apply_log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in cols}) if cols else df


def skew_improvement(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skewness before and after log1p, both from one pass."""
    table = per_feature(
        df,
        cols,
        lambda c: {
            "skew_before": adjusted_skew(F.col(c)),
            "skew_after": adjusted_skew(F.log1p(F.when(F.col(c) > -1, F.col(c).cast("double")))),
        },
    )
    return table.withColumn("improvement", F.abs("skew_before") - F.abs("skew_after"))
