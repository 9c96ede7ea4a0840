"""Missing values, duplicates, types and other whole-table quality figures, each from one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravitas.functions.columns import count_where, numeric_columns, pearson, percent, string_columns

CHECK_BATCH = 200


def missing_by_column(df: DataFrame, only_missing: bool = True, limit: int | None = None) -> DataFrame:
    """Null count and percent per column, most first."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(df.columns)])
    long = counts.select(
        "__rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), (F.col("__rows") - F.col(f"__{i}")).alias("missing_count"))
                    for i, c in enumerate(df.columns)
                ]
            )
        ),
    ).select("feature", "missing_count", percent(F.col("missing_count"), F.col("__rows")).alias("missing_percent"))
    if only_missing:
        long = long.where("missing_count > 0")
    ordered = long.orderBy(F.desc("missing_count"), "feature")
    return ordered.limit(limit) if limit else ordered


def missing_total(df: DataFrame) -> DataFrame:
    """Null cells, all cells, percent missing and percent complete."""
    filled = F.lit(0)
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(df.columns)])
    for i in range(len(df.columns)):
        filled = filled + F.col(f"__{i}")
    cells = F.col("__rows") * len(df.columns)
    return counts.select(
        cells.cast("bigint").alias("cells"),
        (cells - filled).cast("bigint").alias("missing_cells"),
        percent(cells - filled, cells).alias("missing_percent"),
        percent(filled, cells).alias("complete_percent"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row; nulls and NaN count as equal.

    Copies collapse in the map-side half of the aggregate, so a row repeated without end costs one shuffled row a task.
    """
    kinds = df.groupBy(*[F.col(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    return kinds.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_percent", percent(F.col("duplicate_rows"), F.col("total_rows")))


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row with the seven scalars of a quality assessment; nulls and copies come from the same aggregate."""
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.when(F.col(c).isNull(), 1).otherwise(0)
    kinds = df.groupBy(*[F.col(c) for c in df.columns]).agg(F.count("*").alias("__n")).select("__n", nulls.alias("__nulls"))
    return kinds.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_records"),
        F.lit(len(df.columns)).cast("bigint").alias("total_features"),
        F.coalesce(F.sum(F.col("__n") * F.col("__nulls")), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_features"),
        F.lit(len(string_columns(df))).cast("bigint").alias("categorical_features"),
    ).withColumn("missing_percentage", percent(F.col("missing_values"), F.col("total_records") * F.col("total_features")))


def dtype_summary(df: DataFrame) -> DataFrame:
    """Number of columns per type, from the schema alone."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_columns long")


def select_by_type(df: DataFrame, target: str | None = None, keyword: str | None = None) -> DataFrame:
    """Numeric and string columns without the target, optionally those whose name holds a keyword."""
    skip = [target] if target else []
    rows = [(c, "numeric") for c in numeric_columns(df, skip)] + [(c, "categorical") for c in string_columns(df, skip)]
    if keyword:
        rows = [r for r in rows if keyword.lower() in r[0].lower()]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def dataset_overview(df: DataFrame, target: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("features"),
        F.count_distinct(F.col(target)).alias("target_classes"),
    )


def missing_correlation(df: DataFrame, top: int = 5, threshold: float = 0.5) -> DataFrame:
    """Pearson correlation of the null indicators of the most-null columns; only pairs beyond the threshold."""
    worst = [r["feature"] for r in missing_by_column(df, limit=top).collect()]
    pairs = [(a, b) for i, a in enumerate(worst) for b in worst[i + 1 :]]
    schema = "feature_1 string, feature_2 string, correlation double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)

    def absent(c: str):
        return F.col(c).isNull().cast("double")

    wide = df.agg(*[pearson(absent(a), absent(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("correlation"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )
    return long.where(F.abs("correlation") > threshold)


def post_prep_checks(df: DataFrame, target: str, declared: T.StructType | None = None) -> DataFrame:
    """Five checks after preparation: nulls, infinities, types, target classes, copies.

    Types are compared with a declared schema when one is given; without one the check passes.
    """
    numeric = numeric_columns(df)
    nulls, infinite = F.lit(0), F.lit(0)
    for c in df.columns:
        nulls = nulls + F.when(F.col(c).isNull(), 1).otherwise(0)
    for c in numeric:
        infinite = infinite + F.when(F.abs(F.col(c).cast("double")) == F.lit(float("inf")), 1).otherwise(0)
    kinds = df.groupBy(*[F.col(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    seen = kinds.select(F.col(target).alias("__t"), "__n", nulls.alias("__nulls"), infinite.alias("__inf"))
    per_class = seen.groupBy("__t").agg(
        F.sum(F.col("__n") * F.col("__nulls")).alias("m"),
        F.sum(F.col("__n") * F.col("__inf")).alias("i"),
        F.sum(F.col("__n") - 1).alias("d"),
    )
    totals = per_class.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("m", "i", "d")], F.count("__t").alias("classes")
    )
    mistyped = 0
    if declared is not None:
        want = {f.name: f.dataType for f in declared}
        mistyped = sum(1 for f in df.schema if want.get(f.name) != f.dataType)

    # Names and verdicts of the checks are fixed values.
    def check(name: str, ok, otherwise: str, details):
        return F.struct(
            F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(otherwise).alias("status"), details.alias("details")
        )

    rows = F.array(
        check("Missing Values", F.col("m") == 0, "FAIL", F.concat(F.lit("null cells: "), F.col("m").cast("string"))),
        check("Infinite Values", F.col("i") == 0, "FAIL", F.concat(F.lit("infinite cells: "), F.col("i").cast("string"))),
        check("Data Types", F.lit(mistyped) == 0, "WARN", F.lit(f"numbers: {len(numeric)} of {len(df.columns)}")),
        check(
            "Target Variable", F.col("classes") > 1, "FAIL", F.concat(F.lit("classes: "), F.col("classes").cast("string"))
        ),
        check("Duplicate Rows", F.col("d") == 0, "WARN", F.concat(F.lit("copies: "), F.col("d").cast("string"))),
    )
    return totals.select(F.inline(rows))


def validation_tally(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def eda_summary(df: DataFrame, insights: Sequence[str] = ()) -> DataFrame:
    """Shape, column kinds and percent missing, with the findings as an array."""
    found = F.array(*[F.lit(x) for x in insights]) if insights else F.array().cast("array<string>")
    totals = missing_total(df)
    return totals.select(
        F.try_divide(F.col("cells"), F.lit(len(df.columns))).cast("bigint").alias("total_records"),
        F.lit(len(df.columns)).cast("bigint").alias("features"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_features"),
        F.lit(len(string_columns(df))).cast("bigint").alias("categorical_features"),
        F.col("missing_percent"),
        found.alias("insights"),
    )
