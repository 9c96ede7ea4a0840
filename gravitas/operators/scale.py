"""Scaling of numeric columns: fit in one pass, apply as arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas.functions.quantiles import fit_quantiles
from gravitas.operators.distributions import per_feature


def detect_binary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whether a column holds both 0 and 1 and nothing else, not even nulls."""
    return per_feature(df, cols, lambda c: {"is_binary": is_binary(F.col(c).cast("double"))}).select("feature", F.coalesce("is_binary", F.lit(False)).alias("is_binary"))


def scalable(df: DataFrame, cols: Sequence[str]) -> list[str]:
    binary = {r["feature"] for r in detect_binary(df, cols).where("is_binary").collect()}
    return [c for c in cols if c not in binary]


class Scaler:
    """(centre, width) per column; a width of 0 counts as 1."""

    def __init__(self, method: str, params: dict[str, tuple[float, float]]):
        self.method = method
        self.params = params

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(w) for c, (m, w) in self.params.items()}
        return df.withColumns(new) if new else df


def is_binary(x: Column) -> Column:
    return (F.count(F.when(x.isNull() | ~x.isin(0.0, 1.0), 1)) == 0) & (F.min(x) < F.max(x))


def fit_scale(df: DataFrame, cols: Sequence[str], method: str = "standard", exclude_binary: bool = False) -> Scaler:
    """standard: mean and population deviation; robust: median and interquartile range; minmax: extremes.

    Binary columns are told apart in the same pass as means, deviations and extremes are taken.
    """
    if not cols:
        return Scaler(method, {})
    params: dict[str, tuple[float, float]] = {}
    if method == "robust":
        cols = scalable(df, cols) if exclude_binary else cols
        for c, (q1, q2, q3) in next(iter(fit_quantiles(df, cols, [0.25, 0.5, 0.75]).values()), {}).items():
            if q2 is not None:
                params[c] = (q2, (q3 - q1) or 1.0)
        return Scaler(method, params)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        pair = (F.min(x), F.max(x) - F.min(x)) if method == "minmax" else (F.avg(x), F.stddev_pop(x))
        aggs += [pair[0].alias(f"m{i}"), pair[1].alias(f"w{i}"), is_binary(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    for i, c in enumerate(cols):
        if row[f"m{i}"] is not None and not (exclude_binary and row[f"b{i}"]):
            params[c] = (row[f"m{i}"], row[f"w{i}"] or 1.0)
    return Scaler("minmax" if method == "minmax" else "standard", params)


def scale_report(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Mean, sample deviation and extremes before and after, from one pass over the table."""
    def build(c: str):
        m, w = scaler.params[c]
        before = F.col(c).cast("double")
        after = (before - F.lit(m)) / F.lit(w)
        out = {}
        for stage, x in (("before", before), ("after", after)):
            out |= {
                f"mean_{stage}": F.avg(x), f"std_{stage}": F.stddev_samp(x), f"min_{stage}": F.min(x), f"max_{stage}": F.max(x)
            }
        return out

    return per_feature(df, list(scaler.params), build)
