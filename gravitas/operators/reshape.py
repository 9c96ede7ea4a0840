"""Limits, ranks, reshaping and union of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First rows in an explicit order; Spark tables have none of their own."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str], absolute: bool = False) -> DataFrame:
    """k largest rows by a column or its absolute value; ``ties`` settle equal ones."""
    measure = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(measure.desc_nulls_last(), *ties).limit(k)


def sort_by_abs(df: DataFrame, by: str, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(by)).desc_nulls_last(), *ties)


def arg_max(label: str | Column, measure: str | Column, ties: Column | None = None) -> Column:
    """Label of the largest measure, as an aggregate; among equal ones the smallest ``ties``, by default the label."""
    lab = F.col(label) if isinstance(label, str) else label
    val = F.col(measure) if isinstance(measure, str) else measure
    then = lab if ties is None else ties
    return F.min_by(lab, F.when(val.isNotNull(), F.struct((-val).alias("m"), then.alias("l"))))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(i) for i in ids], [F.col(c) for c in cols], name, value)


def transpose(df: DataFrame, key: str, values: Sequence[str], labels: Sequence[str], name: str = "metric") -> DataFrame:
    """Swap the axes of a small table: one row per value column, one column per label of ``key``."""
    return df.unpivot([F.col(key)], [F.col(v) for v in values], name, "value").groupBy(name).pivot(key, list(labels)).agg(
        F.first("value")
    )


def left_join_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, int]) -> DataFrame:
    """Left join in which keys without a partner get the defaults; the null key matches itself."""
    r = right.withColumnRenamed(on, "__right_key")
    joined = left.join(r, F.col(on).eqNullSafe(F.col("__right_key")), "left").drop("__right_key")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_by_row_id(features: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Glue features to labels by id, as equal positions did for two frames."""
    return features.join(labels, row_id)


def average_rank(measure: Column, within: Sequence[str | Column], descending: bool = True) -> Column:
    """Rank in which equal values share the mean of their places. For result tables, not base tables."""
    order = measure.desc_nulls_last() if descending else measure.asc_nulls_last()
    place = F.rank().over(Window.partitionBy(*within).orderBy(order))
    same = F.count("*").over(Window.partitionBy(*within, measure))
    return F.when(measure.isNotNull(), place + (same - 1) / F.lit(2.0))


def share_of_group(df: DataFrame, count: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Each count as a share of its group's total."""
    total = F.sum(count).over(Window.partitionBy(*by))
    return df.withColumn(name, F.try_divide(F.col(count).cast("double"), total))


#: Values of one list that stand in one array while pairs are made.
PAIR_BLOCK = 1000


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every value of ``right``, a table of one column of distinct values.

    The values are dealt out to blocks of about ``PAIR_BLOCK``, and every row meets every block by its number; no list of
    values grows with the table. A null value is a value like any other.
    """
    (value,) = right.columns
    blocks = right.agg(F.greatest(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)), F.lit(1)).cast("int")).scalar()
    held = right.withColumn("__block", F.pmod(F.xxhash64(value), blocks).cast("int"))
    arrays = held.groupBy("__block").agg(F.collect_list(F.struct(value)).alias("__values"))
    rows = left.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.join(arrays, "__block").select(*left.columns, F.inline("__values"))
