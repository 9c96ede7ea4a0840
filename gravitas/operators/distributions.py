"""Frequencies, summaries and time distributions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions import quantiles
from gravitas.functions.columns import count_where, decode, is_evening_rush, is_morning_rush, is_night, percent
from gravitas.operators.reshape import arg_max


def per_feature(
    df: DataFrame, cols: Sequence[str], build: Callable[[str], Mapping[str, Column]], by: Sequence[str] = ()
) -> DataFrame:
    """One aggregate over all columns, then one row per group and column."""
    built = {c: build(c) for c in cols}
    aggs = [e.alias(f"__{i}_{n}") for i, c in enumerate(cols) for n, e in built[c].items()]
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"__{i}_{n}").alias(n) for n in built[c]]) for i, c in enumerate(cols)
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def quantile_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> Callable[[str], list[Column]]:
    """Quantile aggregates per column: computed in place if few values are distinct, else fitted and put in as values."""
    cols = list(cols)
    surveyed = quantiles.survey(df, cols)
    few = quantiles.few_distinct(surveyed, cols)
    many = [c for c in cols if c not in few]
    rest = quantiles.part_of_survey(surveyed, cols, many, ())
    fitted = quantiles.narrow_quantiles(df, many, probs, surveyed=rest) if many else {}
    values = fitted.get((), {})
    return lambda c: quantiles.percentile_exprs(c, probs) if c in few else [F.lit(v).cast("double") for v in values[c]]


def describe_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column, optionally per group; null groups drop."""
    for b in by:
        df = df.where(F.col(b).isNotNull())
    probs = [0.25, 0.5, 0.75]
    quartiles = None if by else quantile_columns(df, cols, probs)

    def build(c: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        facts = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        return facts | (dict(zip(("p25", "p50", "p75"), quartiles(c))) if quartiles else {})

    found = per_feature(df, cols, build, by)
    if by:
        # Groups may be many: their quartiles are a table joined by group, never values in the plan.
        per = quantiles.group_quantiles(df, cols, probs, by)
        keys = {b: f"__{b}" for b in [*by, "feature"]}
        per = per.withColumnsRenamed(keys)
        same = F.lit(True)
        for b, k in keys.items():
            same = same & (F.col(b) == F.col(k))
        found = found.join(per, same, "left").withColumns({n: F.get("q", F.lit(i)) for i, n in enumerate(("p25", "p50", "p75"))})
    return found.select(*by, "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def boxplot_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Five-number summary of a measure per class."""
    return describe_numeric(df, [col], [by]).select(by, "count", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Frequency per value, nulls left out, most frequent first, equal ones by value."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    ordered = counted.orderBy(F.desc("n"), "value")
    return ordered.limit(limit) if limit else ordered


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """One row with the most frequent value; among equally frequent ones the smallest. No value buffer in one task."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counted.agg(arg_max("value", "n").alias("mode"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent per class; the percent is of all rows, also those without a class."""
    counted = df.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.where(F.col("value").isNotNull()).withColumn("percent", percent(F.col("n"), total))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest and smallest class in percent, their ratio, and how severe it is."""
    dist = target_distribution(df, target)
    ratio = F.try_divide(F.max("n").cast("double"), F.min("n"))
    return dist.agg(F.max("percent").alias("max_percent"), F.min("percent").alias("min_percent"), ratio.alias("ratio")).select(
        "*",
        (F.col("ratio") > preset.SEVERE_FROM).alias("significant"),
        F.when(F.col("ratio") < preset.BALANCED_BELOW, "balanced")
        .when(F.col("ratio") < preset.SEVERE_FROM, "moderate")
        .otherwise("severe")
        .alias("level"),
    )


def profile_categorical(df: DataFrame, col: str, top: int = 5) -> DataFrame:
    """The most frequent values with their percent of all rows, next to distinct count, mode and null count."""
    counted = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    facts = counted.agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        arg_max("value", F.when(F.col("value").isNotNull(), F.col("n"))).alias("most_frequent"),
    )
    # Nulls sort last and are dropped after the limit, so both branches share one aggregate of the table.
    best = counted.orderBy(F.col("value").isNull(), F.desc("n"), "value").limit(top).where(F.col("value").isNotNull())
    whole = facts.select(F.struct("*")).scalar()
    return best.withColumn("f", whole).select(
        "value", "n", percent(F.col("n"), F.col("f.rows")).alias("percent"),
        F.col("f.unique_values").alias("unique_values"), F.col("f.most_frequent").alias("most_frequent"),
        F.col("f.missing").alias("missing"),
    )


def hourly_distribution(df: DataFrame, hour: str) -> DataFrame:
    """Rows per hour, with the busiest marked; the lowest hour on a tie."""
    return marked_counts(df, hour, F.col(hour))


def marked_counts(df: DataFrame, col: str, label: Column) -> DataFrame:
    """Count per code with its label; ``is_peak`` marks the largest, the lowest code on a tie."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col)).agg(F.count("*").alias("n"))
    peak = counted.agg(arg_max(col, "n").alias("peak")).scalar()
    return counted.select(F.col(col).alias("code"), label.alias("label"), "n", (F.col(col) == peak).alias("is_peak"))


def rush_hour_totals(df: DataFrame, hour: str) -> DataFrame:
    h = F.col(hour)
    return df.agg(
        count_where(is_morning_rush(h)).alias("morning_rush"),
        count_where(is_evening_rush(h)).alias("evening_rush"),
        count_where(is_night(h)).alias("night"),
    )


def daily_distribution(df: DataFrame, day: str) -> DataFrame:
    """Rows per day name with the busiest marked; weekend and weekday totals count an absent day as 0."""
    days = marked_counts(df, day, decode(F.col(day), preset.DAY_NAMES))
    weekend = F.sum(F.when(F.col("code").isin(*preset.WEEKEND), F.col("n")).otherwise(0)).over(Window.partitionBy())
    weekday = F.sum(F.when(F.col("code").between(1, 5), F.col("n")).otherwise(0)).over(Window.partitionBy())
    return days.withColumns({"weekend_total": weekend, "weekday_total": weekday})


def monthly_distribution(df: DataFrame, month: str) -> DataFrame:
    return marked_counts(df, month, decode(F.col(month), preset.MONTH_ABBR))


def category_top10(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k commonest categories, each beside the number of distinct ones; the first is the most common."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    facts = counted.agg(F.count("*").alias("n_categories"), arg_max("value", "n").alias("most_common"))
    return (
        counted.orderBy(F.desc("n"), "value")
        .limit(k)
        .withColumn("f", facts.select(F.struct("*")).scalar())
        .select("value", "n", "f.n_categories", (F.col("value") == F.col("f.most_common")).alias("is_most_common"))
    )


def histogram_bins(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width counts between the smallest and largest value; the largest falls in the last bin, empty bins stay."""
    x = F.col(col).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("ends")).scalar()
    keep = df.where(F.col(col).isNotNull())
    if by:
        keep = keep.where(F.col(by).isNotNull())
    share = F.try_divide(x - F.col("e.lo"), F.nullif(F.col("e.hi") - F.col("e.lo"), F.lit(0.0)))
    # least skips nulls, so a column of one value is told apart: all of it falls in the first bin.
    place = F.when(share.isNotNull(), F.least(F.floor(share * bins) + 1, F.lit(bins)))
    group = [by] if by else []
    binned = keep.withColumn("e", ends).select(*group, F.coalesce(place, F.lit(1)).cast("int").alias("bin"))
    counted = binned.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    if by:
        return counted
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return (
        grid.join(counted, "bin", "left")
        .withColumn("e", ends)
        .select(
            "bin",
            (F.col("e.lo") + width * (F.col("bin") - 1)).alias("lower"),
            (F.col("e.lo") + width * F.col("bin")).alias("upper"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def injury_stats_by_target(df: DataFrame, target: str, measure: str) -> DataFrame:
    """Mean, median and sample deviation of a measure per class."""
    return describe_numeric(df, [measure], [target]).select(target, "mean", F.col("p50").alias("median"), "std")
