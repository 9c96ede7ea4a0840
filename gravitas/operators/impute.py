"""Filling missing values: fit to a small list of parameters, apply as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravitas import preset
from gravitas.functions.buckets import ROWS_PER_BUCKET
from gravitas.functions.columns import numeric_columns, string_columns
from gravitas.functions.quantiles import fit_quantiles, is_few
from gravitas.operators.reshape import arg_max
from gravitas.session import ensure_checkpoint_dir

SUMMARY = "feature string, method string, fill_value string, missing_count long"


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per string column, the smallest on a tie; one shuffle for all columns."""
    if not cols:
        return {}
    long = df.unpivot([], [F.col(c) for c in cols], "feature", "value").where(F.col("value").isNotNull())
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return {r["feature"]: r["mode"] for r in counted.groupBy("feature").agg(arg_max("value", "n").alias("mode")).collect()}


def medians(df: DataFrame, cols: Sequence[str], few: Sequence[str] | None = None) -> dict[str, float]:
    if not cols:
        return {}
    fitted = next(iter(fit_quantiles(df, cols, [0.5], few=few).values()), {})
    return {c: v[0] for c, v in fitted.items() if v[0] is not None}


def null_counts(df: DataFrame, cols: Sequence[str], sketched: Sequence[str] = ()) -> tuple[int, dict[str, int], dict[str, int]]:
    """Rows, nulls per column, and about how many distinct values the ``sketched`` columns have, in one pass."""
    row = df.agg(
        F.count("*").alias("__rows"),
        *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(F.col(c), 0.05).alias(f"__d{i}") for i, c in enumerate(sketched)],
    ).first()
    nulls = {c: row["__rows"] - row[f"__{i}"] for i, c in enumerate(cols)}
    return row["__rows"], nulls, {c: row[f"__d{i}"] for i, c in enumerate(sketched)}


class Imputer:
    """Fill values per column, as fitted on one table."""

    def __init__(self, fills: dict[str, tuple[str, object, int]]):
        self.fills = fills

    def transform(self, df: DataFrame) -> DataFrame:
        new: dict[str, Column] = {}
        for c, (_, value, nulls) in self.fills.items():
            kind = df.schema[c].dataType
            if not nulls:  # a null that fitting has not seen; the column keeps its type
                new[c] = F.coalesce(F.col(c), F.lit(value).cast(kind))
                continue
            whole = isinstance(value, float) and isinstance(kind, T.IntegralType)
            col = F.col(c).cast("double") if whole else F.col(c)
            new[c] = F.coalesce(col, F.lit(value))
        return df.withColumns(new) if new else df

    def summary(self, df: DataFrame) -> DataFrame:
        rows = [(c, m, _text(v), n) for c, (m, v, n) in self.fills.items()]
        return df.sparkSession.createDataFrame(rows, SUMMARY)


def _text(value: object) -> str:
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def fit_auto(
    df: DataFrame, mostly_null_percent: float | None = preset.MOSTLY_NULL_PERCENT, every: bool = False
) -> Imputer:
    """Mode for strings and median for numbers, in columns with nulls that are not mostly null.

    With ``mostly_null_percent`` None no column is left out: the mode-median strategy. With ``every`` columns without
    nulls get a fill as well, for rows that come later.
    """
    text, numeric = string_columns(df), numeric_columns(df)
    rows, nulls, distinct = null_counts(df, [*text, *numeric], numeric)
    bound = 100.0 if mostly_null_percent is None else mostly_null_percent
    todo = [c for c, n in nulls.items() if (every or n > 0) and n < rows and n * 100.0 / rows <= bound]
    by_mode = modes(df, [c for c in todo if c in text])
    gaps = [c for c in todo if c in numeric]
    by_median = medians(df, gaps, [c for c in gaps if is_few(distinct[c])])
    fills: dict[str, tuple[str, object, int]] = {}
    for c in df.columns:
        if c in by_mode:
            fills[c] = ("mode", by_mode[c], nulls[c])
        elif c in by_median:
            fills[c] = ("median", float(by_median[c]), nulls[c])
    return Imputer(fills)


def fit_mean(df: DataFrame, cols: Sequence[str]) -> Imputer:
    """Mean per numeric column that has nulls."""
    rows, nulls, _ = null_counts(df, cols)
    todo = [c for c in cols if 0 < nulls[c] < rows]
    if not todo:
        return Imputer({})
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in todo]).first()
    return Imputer({c: ("mean", means[c], nulls[c]) for c in todo})


def impute_drop(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols is not None else None)


def impute_ffill(
    df: DataFrame, cols: Sequence[str], order: str, row_id: str, by: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Last known value before each row, in ``order``, then ``row_id``, within ``by``.

    Rows are split by ranges of the pair (order, id), so one key or one order value may hold any share of the table: a
    range is filled by itself, and what is still missing at its start comes from the last known value of the ranges
    before it. Where there is more than one range the ranges are written down, as several steps must agree on them.
    """
    ranges = math.ceil(df.count() / (rows_per_bucket or ROWS_PER_BUCKET))
    if ranges > 1:
        ensure_checkpoint_dir(df.sparkSession)
        ranged = df.repartitionByRange(ranges, order, row_id).withColumn("__bucket", F.spark_partition_id()).checkpoint()
    else:
        ranged = df.withColumn("__bucket", F.lit(0))
    inside = Window.partitionBy(*by, "__bucket").orderBy(order, row_id).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(F.col(order), F.col(row_id))
    lasts = ranged.groupBy(*by, "__bucket").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__l_{c}") for c in cols]
    )
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *by, "__bucket", *[F.last(f"__l_{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in cols]
    )
    filled = ranged.withColumns({f"__f_{c}": F.last(c, ignorenulls=True).over(inside) for c in cols})
    on = F.col("l.__bucket") == F.col("r.__bucket")
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    joined = filled.alias("l").join(carried.alias("r"), on, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"l.__f_{c}"), F.col(f"r.__c_{c}")).alias(c) if c in cols else F.col(f"l.{c}").alias(c)
            for c in df.columns
        ]
    )
