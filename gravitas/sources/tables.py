"""Reading tables: typed CSV with null tokens, Parquet, fallbacks, and labelled splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens that a CSV reader of data frames takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here; Spark would compare it as the largest number."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name)
            for f in df.schema
        ]
    )


def _known(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def normalise_text(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text columns to the types of ``schema``; null tokens and unparseable values become null."""
    typed = df.select(*[_known(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema])
    return nan_to_null(typed)


def infer_schema(df: DataFrame) -> T.StructType:
    """Type of every text column from one pass over all its values: bigint, else double, else boolean, else string."""
    checks = []
    for i, c in enumerate(df.columns):
        v = _known(F.col(c))
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))).alias(f"i{i}"),
            F.count(v.try_cast("double")).alias(f"d{i}"),
            F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{i}"),
        ]
    seen = df.agg(*checks).first()

    def pick(i: int) -> T.DataType:
        n = seen[f"n{i}"]
        if n == 0:
            return T.DoubleType()
        for name, kind in (("i", T.LongType()), ("d", T.DoubleType()), ("b", T.BooleanType())):
            if seen[f"{name}{i}"] == n:
                return kind
        return T.StringType()

    return T.StructType([T.StructField(c, pick(i)) for i, c in enumerate(df.columns)])


def scan_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """A table from Parquet, or from header CSV with a given or inferred schema. Missing files raise.

    A CSV whose quoted fields hold line breaks needs ``multi_line``; each such file is read by one task.
    """
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    text = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return normalise_text(text, schema if schema is not None else infer_schema(text))


def scan_resolve(spark: SparkSession, candidates: Sequence[tuple[str, str]]) -> tuple[DataFrame, str]:
    """First readable of ``(path, format)``, in order; also which path it was."""
    for path, fmt in candidates:
        try:
            return scan_table(spark, path, fmt), path
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"none of the paths exists: {[p for p, _ in candidates]}")


def scan_splits(spark: SparkSession, path: str, target: str, include_validation: bool = True) -> dict[str, DataFrame]:
    """Labelled splits from a table partitioned by ``split``; train and test must be there and hold the target."""
    table = spark.read.option("recursiveFileLookup", False).parquet(path)
    for needed in ("split", target):
        if needed not in table.columns:
            raise ValueError(f"column {needed!r} not found in {path}")
    present = {r["split"] for r in table.select("split").distinct().collect()}
    absent = {"train", "test"} - present
    if absent:
        raise FileNotFoundError(f"splits not found: {sorted(absent)}")
    names = ["train", "test"] + (["validation"] if include_validation and "validation" in present else [])
    return {n: table.where(F.col("split") == n).drop("split") for n in names}


def same_columns(left: DataFrame, right: DataFrame) -> None:
    """Names, order and types must agree."""
    if left.dtypes != right.dtypes:
        raise ValueError(f"feature columns differ: {sorted(set(left.dtypes) ^ set(right.dtypes)) or 'in their order'}")
