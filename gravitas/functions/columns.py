"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def require(df: DataFrame, *cols: str) -> None:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}; available: {df.columns}")


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns of a row; nulls count as 0."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def clip(col: Column, lower: float, upper: float) -> Column:
    """Clip to bounds; a null stays null although greatest/least skip nulls."""
    return F.when(col.isNotNull(), F.least(F.greatest(col.cast("double"), F.lit(float(lower))), F.lit(float(upper))))


def decode(col: Column, labels: Mapping[int, str]) -> Column:
    """Code to label; a code outside the map gives null."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col.cast("int"))


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour <= 6)


def is_morning_rush(hour: Column) -> Column:
    return hour.between(7, 9)


def is_evening_rush(hour: Column) -> Column:
    return hour.between(17, 19)


def flag(condition: Column) -> Column:
    """Condition to 0/1; an unknown condition is 0."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def adjusted_skew(col: Column) -> Column:
    """Bias-adjusted sample skew; null below three values, 0 for a constant column."""
    x = col.cast("double")
    n = F.count(x).cast("double")
    g1 = F.when(F.max(x) == F.min(x), F.lit(0.0)).otherwise(F.skewness(x))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson; null instead of a division error when a side is constant."""
    x, y = a.cast("double"), b.cast("double")
    sx = F.stddev_pop(F.when(y.isNotNull(), x))
    sy = F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(sx * sy, F.lit(0.0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the comparisons with SQL do."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
