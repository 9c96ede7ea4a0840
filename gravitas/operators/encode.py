"""Categorical columns to numbers: codes, indicator columns, class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.operators.distributions import per_feature
from gravitas.operators.reshape import arg_max, union_all
from gravitas.session import ensure_checkpoint_dir

BROADCAST_BYTES = 16 << 20
#: A key is common if at least one row of so many has it.
HEAVY_SHARE = 1_000


class LabelEncoder:
    """Code per value of each column, in ascending order of the values. A missing value gets ``null_code``.

    Each column has a checkpointed table that is joined by value, sent to all tasks if it was measured to be small.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame, int, bool]]):
        self.tables = tables

    def classes(self) -> dict[str, int]:
        return {c: n for c, (_, n, _) in self.tables.items()}

    def transform(self, df: DataFrame, null_code: int | None = None, unknown_code: int | None = None) -> DataFrame:
        """Replace values by codes; null becomes the code after the last unless ``null_code`` says otherwise."""
        out = df
        for c, (table, n, small) in self.tables.items():
            side = table.select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}"))
            side = F.broadcast(side) if small else side
            out = out.join(side, F.col(c) == F.col(f"__v_{c}"), "left")
        new = {}
        for c, (_, n, _) in self.tables.items():
            missing = F.lit(n if null_code is None else null_code)
            unknown = F.lit(None).cast("bigint") if unknown_code is None else F.lit(unknown_code)
            code = F.when(F.col(c).isNull(), missing).otherwise(F.coalesce(F.col(f"__c_{c}"), unknown)).cast("bigint")
            new[c] = code
        return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])

    def decode(self, df: DataFrame, col: str, name: str) -> DataFrame:
        table, _, small = self.tables[col]
        side = table.select(F.col("code").alias("__code"), F.col("value").alias(name))
        return df.join(F.broadcast(side) if small else side, F.col(col) == F.col("__code"), "left").drop("__code")


def fit_label(df: DataFrame, cols: Sequence[str]) -> LabelEncoder:
    long = df.unpivot([], [F.col(c) for c in cols], "feature", "value").where(F.col("value").isNotNull()).distinct()
    coded, sizes = sorted_codes(long)
    tables = {}
    for c in cols:
        n, size = sizes.get(c, (0, 0))
        tables[c] = (coded.where(F.col("feature") == c).select("value", "code"), n, size <= BROADCAST_BYTES)
    return LabelEncoder(tables)


def sorted_codes(long: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Position of each value of each feature in ascending order, and number and bytes of values per feature.

    A range-partitioned sort is written down, which fixes the partitions; a code is the size of the partitions before
    a row's own plus its place inside it. The driver sees one row per feature and partition.
    """
    ensure_checkpoint_dir(long.sparkSession)
    fixed = long.orderBy("feature", "value").checkpoint(eager=True)
    placed = fixed.select("feature", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counted = placed.groupBy("feature", "part").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.sum(F.octet_length("value") + 24).alias("bytes")
    ).collect()
    sizes: dict[str, tuple[int, int]] = {}
    starts = []
    for r in sorted(counted, key=lambda r: (r["feature"], r["part"])):
        n, size = sizes.get(r["feature"], (0, 0))
        starts.append((r["feature"], r["part"], n - r["first"]))
        sizes[r["feature"]] = (n + r["n"], size + r["bytes"])
    start = long.sparkSession.createDataFrame(starts, "feature string, part int, start long")
    return placed.join(F.broadcast(start), ["feature", "part"]).select("feature", "value", (F.col("start") + F.col("at")).alias("code")), sizes


def encode_cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values and the most frequent one per column, and whether there are many."""
    long = df.unpivot([], [F.col(c) for c in cols], "feature", "value").where(F.col("value").isNotNull())
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("feature").agg(
        F.count("*").alias("unique_values"), arg_max("value", "n").alias("most_frequent")
    ).withColumn("high_cardinality", F.col("unique_values") > preset.HIGH_CARDINALITY)


def fit_onehot(df: DataFrame, col: str, max_columns: int = 1_000) -> list[str]:
    """The values that get a column each; a caller who wants a wider table says so."""
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"{col} has more than {max_columns} values; raise max_columns or use label codes")
    return sorted(r[0] for r in rows)


def onehot(df: DataFrame, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per fitted value; a missing or unknown value has 0 in all of them."""
    if values is None:
        values = fit_onehot(df, col)
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1).otherwise(0) for v in values}).drop(col)


def fit_target_shares(df: DataFrame, col: str, target: str, classes: Sequence[str]) -> DataFrame:
    """Share of each target class per category, as ``__k`` and one column per class; missing is a category of its own."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(col).alias("__k")).agg(
        *[F.avg(F.when(F.col(target) == k, 1.0).otherwise(0.0)).alias(f"{col}_share_{i}") for i, k in enumerate(classes)]
    )


def encode_target(df: DataFrame, col: str, target: str, classes: Sequence[str], shares: DataFrame | None = None) -> DataFrame:
    """Replace a category by its shares, fitted on ``df`` itself or given; an unknown category has null shares.

    Small tables of shares go to all tasks, see ``join_spread``.
    """
    if shares is None:
        shares = fit_target_shares(df, col, target, classes)
    return join_spread(df, shares, col, "__k").drop("__k", col)


def join_spread(
    df: DataFrame, side: DataFrame, col: str, key: str, limit: int | None = None, heavy_share: int = HEAVY_SHARE, size: Column | None = None
) -> DataFrame:
    """Left join of ``df`` with a table that has one row per key; null is a key like any other.

    The side is measured (``size``: bytes of a row, else those of its key). Up to ``limit`` bytes it goes to all tasks.
    Beyond it, keys with at least one of ``heavy_share`` rows, at most that many, go to all tasks, so that no task gets
    all rows of one; the rest is shuffled.
    """
    own = F.octet_length(F.col(key).cast("string")) if size is None else size
    width = F.coalesce(own, F.lit(0)) + F.lit(8 * len(side.columns) + 16)
    taken = side.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    on = F.col(col).eqNullSafe(F.col(key))
    if taken <= (BROADCAST_BYTES if limit is None else limit):
        return df.join(F.broadcast(side), on, "left")
    counted = df.groupBy(F.col(col).alias("__heavy")).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n")).scalar()
    heavy = counted.where(F.col("__n") * heavy_share >= total).select("__heavy")
    ensure_checkpoint_dir(df.sparkSession)
    sent = side.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("__heavy")), "right").select("__heavy", *side.columns).checkpoint()
    is_heavy = F.col(col).eqNullSafe(F.col("__heavy"))
    common = df.join(F.broadcast(sent), is_heavy).drop("__heavy")
    rare = df.join(F.broadcast(sent.select("__heavy")), is_heavy, "left_anti").join(side, on, "left")
    return common.unionByName(rare)


def feature_kind(df: DataFrame, cols: Sequence[str], below: int = preset.CATEGORICAL_BELOW) -> DataFrame:
    """Categorical if text or with few distinct values, else continuous. Values are counted up to the bound only."""
    counted = distinct_upto(df, cols, below)
    text = [c for c, t in df.dtypes if t == "string"]
    rows = [(c, "categorical" if c in text or n < below else "continuous") for c, n in counted.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def distinct_upto(df: DataFrame, cols: Sequence[str], bound: int) -> dict[str, int]:
    """Exact number of distinct non-null values per column where it is small; a sketch settles the clear cases."""
    row = df.agg(*[F.approx_count_distinct(F.col(c), 0.05).alias(f"__{i}") for i, c in enumerate(cols)]).first()
    out = {c: row[f"__{i}"] for i, c in enumerate(cols)}
    near = [c for c in cols if out[c] < 2 * bound]
    if near:
        exact = df.agg(*[F.size(F.collect_set(F.col(c))).alias(f"__{i}") for i, c in enumerate(near)]).first()
        out.update({c: exact[f"__{i}"] for i, c in enumerate(near)})
    return out


def input_domain(df: DataFrame, cols: Sequence[str], below: int = preset.CATEGORICAL_BELOW) -> DataFrame:
    """Per feature the allowed values, or the range and mean of a continuous one."""
    kinds = {r["feature"]: r["kind"] for r in feature_kind(df, cols, below).collect()}
    few = [c for c in cols if kinds[c] == "categorical"]
    many = [c for c in cols if kinds[c] == "continuous"]
    parts = []
    empty = F.lit(None).cast("double")
    if few:
        long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in few], "feature", "value")
        values = long.where(F.col("value").isNotNull()).distinct()
        blank = [empty.alias(n) for n in ("lowest", "highest", "mean")]
        parts.append(values.select("feature", F.lit("categorical").alias("kind"), "value", *blank))
    if many:
        figures = (("lowest", F.min), ("highest", F.max), ("mean", F.avg))
        ranges = per_feature(df, many, lambda c: {n: f(F.col(c).cast("double")) for n, f in figures})
        unlisted = F.lit(None).cast("string").alias("value")
        parts.append(ranges.select("feature", F.lit("continuous").alias("kind"), unlisted, "lowest", "highest", "mean"))
    return union_all(*parts)
