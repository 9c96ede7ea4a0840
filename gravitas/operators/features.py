"""Engineered columns: dates, time flags, injury measures, weather and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import flag, is_evening_rush, is_morning_rush, is_night, percent, row_sum
from gravitas.operators.distributions import mode_of


def datetime_features(df: DataFrame, col: str, fmt: str = preset.DATE_FORMAT) -> DataFrame:
    """Year, month, day and hour of a text date, which is then dropped; an unreadable date gives nulls."""
    t = F.try_to_timestamp(F.col(col), F.lit(fmt))
    return df.withColumns(
        {
            "crash_year": F.year(t),
            "crash_month": F.month(t),
            "crash_day": F.dayofmonth(t),
            "crash_hour_from_date": F.hour(t),
        }
    ).drop(col)


def time_period(hour: Column) -> Column:
    """0 morning, 1 afternoon, 2 evening, 3 night or unknown."""
    return F.when(hour.between(6, 11), 0).when(hour.between(12, 17), 1).when(hour.between(18, 21), 2).otherwise(3)


def time_flags(df: DataFrame, hour: str) -> DataFrame:
    h = F.col(hour)
    return df.withColumns(
        {
            "is_night": flag(is_night(h)),
            "is_morning_rush": flag(is_morning_rush(h)),
            "is_evening_rush": flag(is_evening_rush(h)),
            "time_period": time_period(h),
        }
    )


def weekend_flag(df: DataFrame, day: str) -> DataFrame:
    return df.withColumn("is_weekend", flag(F.col(day).isin(*preset.WEEKEND)))


def injury_features(df: DataFrame, total: str, parts: Sequence[str], severe: Sequence[str]) -> DataFrame:
    """Whether anybody was severely hurt, and the parts in relation to the total plus one.

    A total of -1 makes the divisor 0: the rate is then infinite, or missing if the parts are 0 too.
    """
    if len(parts) < 2:
        raise ValueError("injury features need at least two part columns")
    parts_sum, divisor = row_sum(parts).cast("double"), (F.col(total) + 1).cast("double")
    endless = F.when(divisor == 0, F.when(parts_sum > 0, F.lit(float("inf"))).when(parts_sum < 0, F.lit(float("-inf"))))
    rate = F.coalesce(F.try_divide(parts_sum, divisor), endless)
    return df.withColumns({"has_severe_injury": flag(row_sum(severe) > 0), "injury_rate": rate})


def bad_weather(df: DataFrame, weather: str, usual: str | None = None) -> DataFrame:
    """1 where the weather is not the commonest, also where it is unknown; ``usual`` is the fitted commonest."""
    mode = F.lit(usual) if usual is not None else mode_of(df, weather).scalar()
    return df.withColumn("bad_weather", flag(~F.col(weather).eqNullSafe(mode)))


def risk_score(df: DataFrame) -> DataFrame:
    """Sum of those of the night, weekend and bad-weather flags that are there."""
    parts = [c for c in ("is_night", "is_weekend", "bad_weather") if c in df.columns]
    if not parts:
        raise ValueError("risk score needs at least one of is_night, is_weekend, bad_weather")
    return df.withColumn("risk_score", row_sum(parts))


def interactions(df: DataFrame) -> DataFrame:
    new = {}
    if {"is_night", "bad_weather"} <= set(df.columns):
        new["night_bad_weather"] = F.col("is_night") * F.col("bad_weather")
    if {"is_weekend", "is_night"} <= set(df.columns):
        new["weekend_night"] = F.col("is_weekend") * F.col("is_night")
    return df.withColumns(new) if new else df


def risk_distribution(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    counted = df.groupBy("risk_score").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def engineer(df: DataFrame, create_interactions: bool = True, usual_weather: str | None = None) -> DataFrame:
    """All features the preset's columns allow; steps whose columns are absent are left out."""
    have = set(df.columns)
    out = df
    if preset.HOUR in have:
        out = time_flags(out, preset.HOUR)
    if preset.DAY in have:
        out = weekend_flag(out, preset.DAY)
    parts = [c for c in preset.INJURY_PARTS if c in have]
    if len(parts) > 1 and preset.TOTAL in have:
        out = injury_features(out, preset.TOTAL, parts, [c for c in preset.SEVERE_PARTS if c in have])
    if preset.WEATHER in have:
        out = bad_weather(out, preset.WEATHER, usual_weather)
    if {"is_night", "is_weekend", "bad_weather"} & set(out.columns):
        out = risk_score(out)
    return interactions(out) if create_interactions else out
