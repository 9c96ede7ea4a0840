"""Contingency tables in long form, dense where zero cells matter, and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import (
    count_where, decode, is_evening_rush, is_morning_rush, is_night, percent,
)
from gravitas.operators.distributions import mode_of
from gravitas.operators.reshape import all_pairs, arg_max

def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of values in which both are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """All combinations of the observed a and b values, absent ones with 0.

    The result has a cell for each pair, so this is for tables meant to be read; ``pair_counts`` has the cells that are
    not 0, for any number of values. ``rows``, a table of a values, names the rows wanted; others are left out before
    their zero cells are made. The condition on n, always true, keeps the count in every branch, so that all of them
    share one aggregate of the table.
    """
    counts = counts.where("n > 0")
    wanted = counts.select("a").distinct() if rows is None else rows
    grid = all_pairs(wanted, counts.select("b").distinct())
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return dense(pair_counts(df, a, b))


def crosstab_row_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each row of the table as percent of the row's total."""
    total = F.sum("n").over(Window.partitionBy("a"))
    return crosstab_counts(df, a, b).select("a", "b", percent(F.col("n"), total).alias("percent"))


def crosstab_wide(df: DataFrame, a: str, b: str, categories: Sequence) -> DataFrame:
    """The table with one column per category of b; the categories are given, so no extra job finds them."""
    counted = pair_counts(df, a, b).groupBy("a").pivot("b", list(categories)).agg(F.sum("n"))
    return counted.na.fill(0)


def top_values(df: DataFrame, tops: dict[str, int]) -> dict[str, list]:
    """The k commonest values of each column, all from one pass."""
    sets = df.groupingSets([[F.col(c)] for c in tops], *tops).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # A column's bit is 0 in the grouping that counts it.
    bits = {c: sum(1 << i for i, o in enumerate(reversed(list(tops))) if o != c) for c in tops}
    limit: Column = F.lit(0)
    value: Column = F.lit(None).cast("string")
    for c, k in tops.items():
        limit = F.when(F.col("g") == bits[c], k).otherwise(limit)
        value = F.when(F.col("g") == bits[c], F.col(c).isNotNull()).otherwise(value)
    known = sets.where(F.coalesce(value.cast("boolean"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), *tops))
    rows = known.withColumn("place", place).where((F.col("place") <= max(tops.values())) & (F.col("place") <= limit)).collect()
    return {c: [r[c] for r in rows if r["g"] == bits[c]] for c in tops}


def keep_top_values(df: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Rows whose value is among the k commonest, for each column; the short lists become filters of the scan."""
    out = df
    for c, values in top_values(df, tops).items():
        out = out.where(F.col(c).isin(values))
    return out


def top_rows_crosstab(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """The k rows of the table with the largest totals."""
    counts = pair_counts(df, a, b)
    best = counts.groupBy("a").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "a").limit(k).select("a")
    return dense(counts, best)


def cross_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    return crosstab_counts(df, a, b)


def risk_slots(df: DataFrame, day: str, hour: str) -> DataFrame:
    """Cells above mean + population deviation over all cells, zeros included; in order of day and hour."""
    # A cell of 0 adds nothing to either sum and is never above the threshold, so only its number matters.
    cells = pair_counts(df, day, hour).where("n > 0")
    grid = (F.count_distinct("a") * F.count_distinct("b")).cast("double")
    n = F.col("n").cast("double")
    mean, squares = F.sum(n) / grid, F.sum(n * n) / grid
    threshold = cells.agg(mean + F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))).scalar()
    hot = cells.withColumn("threshold", threshold).where("n > threshold")
    label = F.concat_ws(" ", decode(F.col("a"), preset.DAY_ABBR), F.concat(F.col("b").cast("string"), F.lit(":00")))
    # At most days x hours rows are left here, so one window over all of them is small.
    order = Window.partitionBy().orderBy("a", "b")
    return hot.select(
        F.row_number().over(order).alias("slot_no"), F.col("a").alias("day"), F.col("b").alias("hour"), label.alias("slot"),
        "n", "threshold", F.count("*").over(Window.partitionBy()).alias("n_slots"),
    )


def severity_rate_by_hour(df: DataFrame, hour: str, target: str) -> DataFrame:
    """Percent of an hour's rows that are not of its commonest class; rows without a class count as not of it."""
    counts = df.where(F.col(hour).isNotNull()).groupBy(F.col(hour).alias("hour"), F.col(target).alias("t")).agg(
        F.count("*").alias("n")
    )
    per_hour = counts.groupBy("hour").agg(
        F.sum("n").alias("rows"), F.max(F.when(F.col("t").isNotNull(), F.col("n"))).alias("mode_n")
    )
    rate = F.round(percent(F.col("rows") - F.col("mode_n"), F.col("rows")), 1)
    rates = per_hour.select("hour", "rows", rate.alias("severity_rate"))
    peak = rates.agg(arg_max("hour", "severity_rate")).scalar()
    return rates.withColumn("is_peak", F.col("hour") == peak)


def risk_category(hour: Column, day: Column) -> Column:
    """Weekend wins over night, night over the default."""
    return (
        F.when(day.isin(*preset.WEEKEND), "Medium Risk (Weekend)").when(is_night(hour), "High Risk (Night)").otherwise("Low Risk")
    )


def risk_category_severity(df: DataFrame, hour: str, day: str, target: str, severe: str | None = None) -> DataFrame:
    """Percent of each class per risk category; the severe class is named, or the alphabetically last."""
    rated = df.select(risk_category(F.col(hour), F.col(day)).alias("risk_category"), target)
    table = crosstab_row_pct(rated, "risk_category", target)
    last = F.lit(severe) if severe else F.max("b").over(Window.partitionBy())
    return table.select(
        F.col("a").alias("risk_category"), F.col("b").alias("severity"), "percent", (F.col("b") == last).alias("is_severe")
    )


def not_mode(df: DataFrame, col: str) -> DataFrame:
    """Rows whose category is not the commonest; a missing category is not the commonest either."""
    return df.where(~F.col(col).eqNullSafe(mode_of(df, col).scalar()))


def interaction_counts(df: DataFrame, hour: str, day: str, weather: str) -> DataFrame:
    """Weekend nights with their percent of all rows, and rush hours in other than the usual weather."""
    h, d = F.col(hour), F.col(day)
    per = df.groupBy(F.col(weather).alias("w")).agg(
        F.count("*").alias("n"),
        count_where(d.isin(*preset.WEEKEND) & is_night(h)).alias("weekend_nights"),
        count_where(is_morning_rush(h) | is_evening_rush(h)).alias("rush"),
    )
    # The usual weather's rush hours are taken off the rush hours of all weathers.
    usual = arg_max(F.col("rush"), F.when(F.col("w").isNotNull(), F.col("n")), ties=F.col("w"))
    nights = F.sum("weekend_nights")
    return per.agg(
        nights.alias("weekend_nights"),
        percent(nights, F.sum("n")).alias("weekend_night_percent"),
        (F.sum("rush") - F.coalesce(usual, F.lit(0))).alias("rush_hour_bad_weather"),
    )


def stacked_histogram(df: DataFrame, col: str, target: str, label: Column | None = None) -> DataFrame:
    shown = label if label is not None else F.col(col)
    return pair_counts(df.select(shown.alias("x"), F.col(target).alias("y")), "x", "y").toDF("value", "class", "n")
