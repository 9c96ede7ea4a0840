"""Exact stratified splits and folds without sorting a class.

Rows are shuffled by an md5 of their id. A split is a range of that order, so it is enough to know the key at each
cut: counts by key prefix find the prefix that holds a cut, longer prefixes inside it, and the last few rows the key
itself. The table is only scanned, never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.hashing import order_key
from gravitas.operators.encode import join_spread
from gravitas.session import ensure_checkpoint_dir

FIRST_STEP = 2
STEP = 3
LEAF_ROWS = 100_000
# Digits of an order key; rows that agree on all of them have the same id.
KEY_DIGITS = 32
# Classes that ``class_counts`` brings to the driver; splits and folds have no such bound.
MAX_CLASSES = 1_000


def class_counts(df: DataFrame, target: str) -> dict:
    rows = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {target!r}")
    return {r[target]: r["n"] for r in rows}


def prefix_counts(df: DataFrame, target: str, row_id: str, seed: int) -> DataFrame:
    """``c, q, n``: rows per class and first digits of the order key, at most 256 rows per class; written down."""
    if not df.where(F.col(row_id).isNull()).isEmpty():
        raise ValueError(f"{row_id!r} has rows without an id; add ids first, as with_row_id does")
    ensure_checkpoint_dir(df.sparkSession)
    keyed = df.where(F.col(target).isNotNull()).select(
        F.col(target).alias("c"), F.substring(order_key(F.col(row_id), seed), 1, FIRST_STEP).alias("q")
    )
    return keyed.groupBy("c", "q").agg(F.count("*").alias("n")).checkpoint()


def _located(cuts: DataFrame, counted: DataFrame) -> DataFrame:
    """``c, rank, p, before, n``: the longer prefix that holds each rank. ``cuts`` has ``c, rank, p, before``, and
    ``counted`` the rows per class, prefix ``p`` and longer prefix ``q``."""
    upto = Window.partitionBy("c", "p").orderBy("q")
    ends = counted.withColumn("upto", F.sum("n").over(upto))
    low = F.col("before") + F.col("upto") - F.col("n")
    hit = (F.col("rank") > low) & (F.col("rank") <= low + F.col("n"))
    return cuts.join(ends, ["c", "p"]).where(hit).select("c", "rank", F.col("q").alias("p"), low.alias("before"), "n")


def _inside(keyed: DataFrame, prefixes: DataFrame, size: int) -> DataFrame:
    """Rows under one of the prefixes ``c, p`` of ``size`` digits, with the prefix as ``p``."""
    return keyed.withColumn("p", F.substring("k", 1, size)).join(prefixes.select("c", "p").distinct(), ["c", "p"], "left_semi")


def cut_table(
    df: DataFrame, target: str, row_id: str, cuts: DataFrame, seed: int = preset.SEED, leaf_rows: int | None = None,
    first: DataFrame | None = None,
) -> DataFrame:
    """``c, rank, key``: the order key at each of the ranks ``c, rank``; rank 1 is the first row of a class.

    Ranks, prefixes and keys are tables joined by class, so there may be any number of classes. A rank is followed down
    prefixes until few rows share its prefix; these are put in order.
    """
    leaf = LEAF_ROWS if leaf_rows is None else leaf_rows
    keyed = df.where(F.col(target).isNotNull()).select(F.col(target).alias("c"), order_key(F.col(row_id), seed).alias("k"))
    counted = first if first is not None else prefix_counts(df, target, row_id, seed)
    wanted = cuts.where("rank > 0").select("c", "rank").distinct()
    start = wanted.select("c", F.col("rank").cast("bigint").alias("rank"), F.lit("").alias("p"), F.lit(0).cast("bigint").alias("before"))
    open_ = _located(start, counted.withColumn("p", F.lit(""))).checkpoint()
    size, settled = FIRST_STEP, None
    while True:
        ready = open_.where(F.col("n") <= leaf)
        rows = _inside(keyed, ready, size).withColumn("at", F.row_number().over(Window.partitionBy("c", "p").orderBy("k")))
        spots = ready.select("c", "p", "rank", (F.col("rank") - F.col("before")).cast("int").alias("at"))
        found = rows.join(spots, ["c", "p", "at"]).select("c", "rank", F.col("k").alias("key"))
        settled = found if settled is None else settled.unionByName(found)
        deep = open_.where(F.col("n") > leaf)
        if deep.isEmpty():
            return settled
        if size >= KEY_DIGITS:
            raise ValueError("an id is repeated so often that its rows cannot be told apart; ids must be unique")
        longer = min(size + STEP, KEY_DIGITS)
        inside = _inside(keyed, deep, size).withColumn("q", F.substring("k", 1, longer))
        open_ = _located(deep.drop("n"), inside.groupBy("c", "p", "q").agg(F.count("*").alias("n"))).checkpoint()
        size = longer


def cut_keys(df: DataFrame, target: str, row_id: str, cuts: dict, seed: int = preset.SEED, leaf_rows: int | None = None) -> dict:
    """For a few classes the keys at the given ranks: ``{class: {rank: key}}``."""
    found: dict = {c: {} for c in cuts}
    rows = [(c, rank) for c, ranks in cuts.items() for rank in ranks if rank > 0]
    if rows:
        table = df.sparkSession.createDataFrame(rows, f"c {df.schema[target].dataType.simpleString()}, rank bigint")
        for r in cut_table(df, target, row_id, table, seed, leaf_rows).collect():
            found[r["c"]][r["rank"]] = r["key"]
    return found


def assign_by_rank(
    df: DataFrame, target: str, row_id: str, parts: Callable[[Column], Sequence[tuple[object, Column]]], name: str,
    seed: int = preset.SEED, leaf_rows: int | None = None,
) -> DataFrame:
    """Label rows by the stretch of their class's shuffled order they fall in; rows without a class have no label.

    ``parts`` gives, for a class size, the labels with the rank each one ends at, in order; row ids must be unique.
    """
    first = prefix_counts(df, target, row_id, seed)
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), end.cast("bigint").alias("rank")) for i, (label, end) in enumerate(parts(F.col("size")))])
    plan = first.groupBy("c").agg(F.sum("n").alias("size")).select("c", "size", F.inline(ends))
    inner = plan.where(F.col("rank") < F.col("size"))
    keys = cut_table(df, target, row_id, inner, seed, leaf_rows, first)
    # A stretch that ends at rank 0 is empty; the last one ends after every key.
    high = F.when(F.col("rank") == F.col("size"), "g").otherwise(F.coalesce("key", F.lit("")))
    whole = plan.join(keys, ["c", "rank"], "left").where("rank > 0").withColumn("high", high)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "high", "label"))), lambda x: F.struct(x["high"].alias("__high"), x["label"].alias("__label")))
    stretches = whole.groupBy(F.col("c").alias("__c")).agg(listed.alias("__s")).checkpoint()
    # Stretches of a class are sorted by upper end; the first one whose end is not before the key holds the row.
    keyed = df.withColumn("__k", order_key(F.col(row_id), seed))
    bytes_each = F.octet_length(F.col("__c").cast("string")) + F.size("__s") * 64
    out = join_spread(keyed, stretches, target, "__c", size=bytes_each)
    hit = F.element_at(F.filter("__s", lambda s: F.col("__k") <= s["__high"]), 1)["__label"]
    return out.withColumn(name, F.when(F.col("__s").isNotNull(), hit)).drop("__k", "__c", "__s")


def quota(n: Column, share: float) -> Column:
    """Rows of a class of n that a share amounts to, halves away from zero."""
    return F.floor(n * F.lit(share) + F.lit(0.5))


def split_stratified(
    df: DataFrame, target: str, row_id: str, test_size: float = preset.TEST_SIZE,
    validation_size: float = preset.VALIDATION_SIZE, seed: int = preset.SEED, leaf_rows: int | None = None,
) -> DataFrame:
    """Add ``split``: test, then validation as a share of the rest, then train; the same shares in every class."""

    def parts(n: Column):
        test = quota(n, test_size)
        return [("test", test), ("validation", test + quota(n - test, validation_size)), ("train", n)]

    return assign_by_rank(df, target, row_id, parts, "split", seed, leaf_rows)


def stratified_folds(
    df: DataFrame, target: str, row_id: str, k: int = 5, seed: int = preset.SEED, leaf_rows: int | None = None
) -> DataFrame:
    """Add ``fold`` 0..k-1 with sizes that differ by at most one inside a class."""
    return assign_by_rank(df, target, row_id, lambda n: [(i, F.call_function("div", n * (i + 1), F.lit(k))) for i in range(k)], "fold", seed, leaf_rows)


def split_class_distribution(df: DataFrame, target: str) -> DataFrame:
    counted = df.groupBy("split", F.col(target).alias("class")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("split"))))
