"""Interquartile outliers: bounds, summary, affected rows, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import count_where, percent
from gravitas.functions.quantiles import fit_quantiles
from gravitas.operators.distributions import per_feature

Bounds = dict[str, tuple[float, float, float, float]]


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = preset.IQR_FACTOR) -> Bounds:
    """Q1, Q3 and the bounds ``factor`` interquartile ranges beyond them; columns without values are left out."""
    fitted = fit_quantiles(df, cols, [0.25, 0.75])
    out: Bounds = {}
    for c, (q1, q3) in next(iter(fitted.values()), {}).items():
        if q1 is not None:
            out[c] = (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def outside(col: str, lower: float, upper: float) -> Column:
    return (F.col(col) < F.lit(lower)) | (F.col(col) > F.lit(upper))


def outlier_iqr_summary(df: DataFrame, cols: Sequence[str], bounds: Bounds | None = None) -> DataFrame:
    """Per column: quartiles, bounds, extremes, outliers, their percent of all rows and their extremes."""
    found = bounds if bounds is not None else iqr_bounds(df, cols)

    def build(c: str) -> dict[str, Column]:
        q1, q3, lo, hi = found[c]
        x = F.col(c).cast("double")
        out = outside(c, lo, hi)
        return {
            "q1": F.first(F.lit(q1)), "q3": F.first(F.lit(q3)),
            "lower_bound": F.first(F.lit(lo)), "upper_bound": F.first(F.lit(hi)),
            "min": F.min(x), "max": F.max(x),
            "outliers": count_where(out), "percent": percent(count_where(out), F.count("*")),
            "min_outlier": F.min(F.when(out, x)), "max_outlier": F.max(F.when(out, x)),
        }

    return per_feature(df, list(found), build)


def outlier_records(df: DataFrame, cols: Sequence[str], bounds: Bounds | None = None) -> DataFrame:
    """Rows outlying in at least one column, and in more than one."""
    found = bounds if bounds is not None else iqr_bounds(df, cols)
    hits = F.lit(0)
    for c, (_, _, lo, hi) in found.items():
        hits = hits + F.when(outside(c, lo, hi), 1).otherwise(0)
    counted = df.select(hits.alias("hits"))
    return counted.agg(
        count_where(F.col("hits") >= 1).alias("any_outlier"),
        percent(count_where(F.col("hits") >= 1), F.count("*")).alias("any_outlier_percent"),
        count_where(F.col("hits") > 1).alias("multiple_outliers"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("outlier_instances"),
    )


def outlier_flags(summary: DataFrame) -> DataFrame:
    """Advice per column, and which column is worst."""
    worst = summary.agg(F.min_by("feature", F.struct(-F.round(F.col("percent"), 9), F.col("feature")))).scalar()
    return summary.select(
        "feature",
        (F.col("percent") > 5).alias("cap_or_transform"),
        F.coalesce(F.col("max_outlier") > F.col("upper_bound") * 3, F.lit(False)).alias("investigate"),
        (F.col("feature") == worst).alias("is_worst"),
    )
