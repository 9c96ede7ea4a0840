"""Range rules and consistency of parts with their total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravitas.functions.columns import count_where, row_sum

Rule = tuple[str, float, float | None, str]


def domain_rules(df: DataFrame, rules: Sequence[Rule], examples: int = 5) -> DataFrame:
    """Violations, verdict and the smallest distinct violating values per rule; nulls pass.

    Only violating values are shuffled, each once per task.
    """
    tests = []
    for c, lo, hi, _ in rules:
        bad = F.col(c) < F.lit(lo)
        if hi is not None:
            bad = bad | (F.col(c) > F.lit(hi))
        tests.append(F.struct(F.lit(c).alias("feature"), F.when(bad, F.col(c).cast("double")).alias("value")))
    long = df.select(F.inline(F.array(*tests))).where(F.col("value").isNotNull())
    # The condition, always true, keeps the count in both branches below: they share one aggregate of the table.
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    shown = (
        values.withColumn("p", place)
        .where(F.col("p") <= examples)
        .groupBy("feature")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("value")), lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))), ",").alias("examples"))
    )
    totals = values.groupBy("feature").agg(F.sum("n").alias("invalid_count"))
    listed = df.sparkSession.createDataFrame([(c, d) for c, _, _, d in rules], "feature string, rule string")
    return (
        listed.join(F.broadcast(totals), "feature", "left")
        .join(F.broadcast(shown), "feature", "left")
        .select(
            "feature",
            "rule",
            F.coalesce("invalid_count", F.lit(0)).alias("invalid_count"),
            F.when(F.coalesce("invalid_count", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("status"),
            F.coalesce("examples", F.lit("")).alias("examples"),
        )
    )


def injury_consistency(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose total is below the sum of its parts; a missing total passes, a missing part is 0."""
    if len(parts) < 2:
        raise ValueError("consistency needs at least two part columns")
    bad = count_where(F.col(total) < row_sum(parts))
    return df.agg(bad.alias("invalid_count")).select(
        F.lit(f"{total}_consistency").alias("feature"),
        F.lit("Total >= sum of categories").alias("rule"),
        "invalid_count",
        F.when(F.col("invalid_count") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def rules_summary(ranges: DataFrame, consistency: DataFrame) -> DataFrame:
    """Rules, failed rules and invalid values; the consistency check is a rule but adds no invalid values."""
    both = ranges.select("status", "invalid_count").unionByName(
        consistency.select("status", F.lit(0).cast("bigint").alias("invalid_count"))
    )
    return both.agg(
        F.count("*").alias("n_rules"),
        count_where(F.col("status") == "FAIL").alias("failed_rules"),
        F.sum("invalid_count").alias("total_invalid"),
    )
