"""Capping outliers at fitted bounds; rows are never removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import clip, count_where, percent
from gravitas.functions.quantiles import fit_quantiles
from gravitas.operators.distributions import per_feature
from gravitas.operators.outliers import outside

# Fixed value: scale of the modified z-score.
MAD_SCALE = 0.6745
SUMMARY = (
    "feature string, outliers_detected long, outliers_percent double, method string, lower_bound double, upper_bound double"
)


class Capper:
    """Bounds per column that has at least one outlier, and the condition that finds them."""

    def __init__(self, method: str, bounds: dict[str, tuple[float, float, Column]]):
        self.method = method
        self.bounds = bounds

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: clip(F.col(c), lo, hi) for c, (lo, hi, _) in self.bounds.items()}
        return df.withColumns(new) if new else df

    def summary(self, df: DataFrame) -> DataFrame:
        """Outliers in the table the bounds were fitted on, counted in one pass."""
        if not self.bounds:
            return df.sparkSession.createDataFrame([], SUMMARY)

        def build(c: str) -> dict[str, Column]:
            lo, hi, hit = self.bounds[c]
            return {
                "outliers_detected": count_where(hit), "outliers_percent": percent(count_where(hit), F.count("*")),
                "method": F.first(F.lit(self.method)), "lower_bound": F.first(F.lit(float(lo))), "upper_bound": F.first(F.lit(float(hi))),
            }

        return per_feature(df, list(self.bounds), build)


def fit_cap(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = preset.IQR_FACTOR) -> Capper:
    """Bounds from quantiles or moments. Whether a column has outliers at all follows from its extremes."""
    if method == "none" or not cols:
        return Capper(method, {})
    if method == "iqr":
        return Capper(method, _iqr_bounds(df, cols, threshold))
    if method == "zscore":
        return Capper(method, _zscore_bounds(df, cols, threshold))
    if method == "robust":
        return Capper(method, _mad_bounds(df, cols, threshold))
    raise ValueError(f"unknown method {method!r}; use iqr, zscore, robust or none")


def _fitted(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    rows = next(iter(fit_quantiles(df, cols, probs).values()), {})
    return {c: v for c, v in rows.items() if v[0] is not None}


def _iqr_bounds(df: DataFrame, cols: Sequence[str], t: float) -> dict:
    out = {}
    for c, (low, q1, q3, high) in _fitted(df, cols, [0.0, 0.25, 0.75, 1.0]).items():
        lo, hi = q1 - t * (q3 - q1), q3 + t * (q3 - q1)
        if low < lo or high > hi:
            out[c] = (lo, hi, outside(c, lo, hi))
    return out


def _zscore_bounds(df: DataFrame, cols: Sequence[str], t: float) -> dict:
    """Outlying by the population deviation, capped at bounds from the sample deviation; a column with nulls has none."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        figures = {"n": F.count(x), "m": F.avg(x), "p": F.stddev_pop(x), "s": F.stddev_samp(x), "l": F.min(x), "h": F.max(x)}
        aggs += [e.alias(f"{n}{i}") for n, e in figures.items()]
    row = df.agg(F.count("*").alias("__rows"), *aggs).first()
    out = {}
    for i, c in enumerate(cols):
        mean, pop, samp = row[f"m{i}"], row[f"p{i}"], row[f"s{i}"]
        if row[f"n{i}"] < row["__rows"] or not pop:
            continue
        if max(mean - row[f"l{i}"], row[f"h{i}"] - mean) / pop > t:
            hit = F.abs((F.col(c) - F.lit(mean)) / F.lit(pop)) > F.lit(float(t))
            out[c] = (mean - t * samp, mean + t * samp, hit)
    return out


def _mad_bounds(df: DataFrame, cols: Sequence[str], t: float) -> dict:
    """Modified z-score around the median. A column whose MAD is 0 is left alone: its bounds would erase every value."""
    mids = {c: v[0] for c, v in _fitted(df, cols, [0.5]).items()}
    if not mids:
        return {}
    spread = df.select(*[F.abs(F.col(c) - F.lit(m)).alias(c) for c, m in mids.items()])
    out = {}
    for c, (mad, far) in _fitted(spread, list(mids), [0.5, 1.0]).items():
        if mad and MAD_SCALE * far / mad > t:
            m = mids[c]
            hit = F.abs(F.lit(MAD_SCALE) * (F.col(c) - F.lit(m)) / F.lit(mad)) > F.lit(float(t))
            out[c] = (m - t * mad / MAD_SCALE, m + t * mad / MAD_SCALE, hit)
    return out
