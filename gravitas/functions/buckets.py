"""Order-based computations split into even value ranges, so that no task sorts a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 10_000


def with_range_bucket(df: DataFrame, col: str, name: str = "bucket", rows_per_bucket: int | None = None) -> DataFrame:
    """Add the number of the value range a row falls in; ranges hold about ``rows_per_bucket`` rows over all groups.

    Rows without a value are range -1, however many ranges there are.
    """
    per = rows_per_bucket or ROWS_PER_BUCKET
    value = F.col(col).cast("double")
    total = df.agg(F.count(value)).first()[0]
    n = min(MAX_BUCKETS, max(1, math.ceil(total / per)))
    if n == 1:
        return df.withColumn(name, F.when(value.isNull(), -1).otherwise(0))
    marks = df.agg(F.percentile_approx(value, [j / n for j in range(1, n)], max(10_000, 4 * n))).first()[0]
    splits = [-math.inf, *sorted(set(marks)), math.inf]
    keyed = df.withColumn("__range_value", value)
    made = Bucketizer(splits=splits, inputCol="__range_value", outputCol="__range_bucket", handleInvalid="keep").transform(keyed)
    return made.withColumn(name, F.coalesce(F.when(F.col("__range_value").isNotNull(), F.col("__range_bucket")).cast("int"), F.lit(-1))).drop("__range_value", "__range_bucket")


def running_sums(
    df: DataFrame, group: Sequence[str], bucket: str, order: Column, sums: dict[str, str], descending: bool = False
) -> DataFrame:
    """Running sums inside a group, in ``order``: sorted within a bucket, plus the total of the buckets before it.

    ``sums`` maps each new column to the column it adds up. Only the bucket totals, at most MAX_BUCKETS per group,
    are ever sorted together. A null group is a group like any other.
    """
    step = F.col(bucket).desc() if descending else F.col(bucket).asc()
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inner = Window.partitionBy(*group, bucket).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [*group, bucket]
    offsets = offsets.withColumnsRenamed({k: f"__g_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{i}"))
    joined = df.withColumns({f"__i_{n}": F.sum(c).over(inner) for n, c in sums.items()}).join(offsets, same)
    joined = joined.drop(*[f"__g_{i}" for i in range(len(keys))])
    return joined.withColumns({n: F.col(f"__i_{n}") + F.col(f"__o_{n}") for n in sums}).drop(
        *[f"__{k}_{n}" for n in sums for k in "io"]
    )
