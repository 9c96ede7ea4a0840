"""Order keys and draws that depend on the row alone, so results repeat under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of a draw in bits; 8 hex digits of an md5.
DRAW_RANGE = float(2**32)


def order_key(row_id: Column, seed: int) -> Column:
    """32 hex digits that shuffle rows by id and seed."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def draw_key(row_id: Column, draw: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", row_id.cast("string"), draw.cast("string"), F.lit(str(seed))))


def hex_slice(key: Column, start: int) -> Column:
    """8 hex digits from ``start`` (1-based) as an integer in [0, 2^32)."""
    return F.conv(F.substring(key, start, 8), 16, 10).cast("bigint")


def unit_draw(key: Column, start: int) -> Column:
    return hex_slice(key, start) / F.lit(DRAW_RANGE)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a unique text id that depends on a row's values alone: their md5 and a number among equal rows.

    Equal rows are counted before the shuffle, so it moves each distinct row about once.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    content = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary"))
    numbered = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return numbered.select(F.concat_ws("-", content, F.col("__i").cast("string")).alias(name), *df.columns)
