"""Oversampling of smaller classes along segments to near neighbours.

Every draw follows from an md5 of row id, draw number and seed, so results do not depend on partitioning. Draws are
dealt out evenly: with N rows to add to a class of n, each row is a base N // n times and the first N % n rows of the
shuffled order once more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.hashing import draw_key, hex_slice, order_key, unit_draw
from gravitas.operators.knn import as_points, nearest_neighbours
from gravitas.operators.reshape import left_join_default
from gravitas.operators.split import class_counts, cut_keys
from gravitas.session import ensure_checkpoint_dir

# Fixed value: neighbours looked at to tell whether a row lies on a border between classes.
BORDER_NEIGHBOURS = 10
DRAWS_PER_BLOCK = 10_000


def imbalance_ratio(counts: dict) -> float:
    return max(counts.values()) / min(counts.values()) if counts else 1.0


def rows_short(counts: Mapping, strategy: str | float | Mapping = "auto") -> dict:
    """Rows to add per class. ``auto`` (also ``not majority`` and ``all``) raises every class to the largest, ``minority``
    the smallest one only (of equal ones the first by value), ``not minority`` all but that one. A number is the wanted
    share of the smaller class in the larger one, for two classes; a mapping names the wanted size of some classes.
    """
    top, least = max(counts.values()), min(sorted(counts), key=counts.__getitem__)
    if isinstance(strategy, Mapping):
        unknown = [c for c in strategy if c not in counts]
        if unknown:
            raise ValueError(f"classes {unknown} are not in the table")
        wanted = dict(strategy)
    elif isinstance(strategy, str):
        chosen = {
            "auto": list(counts), "not majority": list(counts), "all": list(counts), "minority": [least],
            "not minority": [c for c in counts if c != least],
        }
        if strategy not in chosen:
            raise ValueError(f"unknown strategy {strategy!r}; use one of {sorted(chosen)}, a number or a mapping")
        wanted = {c: top for c in chosen[strategy]}
    elif len(counts) != 2:
        raise ValueError("a number as strategy needs two classes")
    else:
        wanted = {least: int(strategy * top)}
    shrunk = [c for c, n in wanted.items() if n < counts[c]]
    if shrunk:
        raise ValueError(f"classes {shrunk} already have more rows than wanted")
    return {c: n - counts[c] for c, n in wanted.items() if n > counts[c]}


def resample(
    df: DataFrame, target: str, row_id: str, features: Sequence[str], method: str = "smote",
    k: int = preset.NEIGHBOURS, seed: int = preset.SEED, trace: bool = False, strategy: str | float | Mapping = "auto",
) -> DataFrame:
    """The table with synthetic rows added until smaller classes have the size that ``strategy`` names (see
    ``rows_short``), by default that of the largest; ``is_synthetic`` marks them.

    A ratio below 2, or method none, leaves the rows as they are. Synthetic rows have no id; with ``trace`` they name
    the two rows they lie between.
    """
    if method not in ("smote", "adasyn", "borderline", "none"):
        raise ValueError(f"unknown method {method!r}; use smote, adasyn, borderline or none")
    kept = [row_id, target, *features]
    kind = df.schema[row_id].dataType
    extra = {"base_id": F.lit(None).cast(kind), "neighbour_id": F.lit(None).cast(kind)} if trace else {}
    originals = df.select(*kept).withColumns({"is_synthetic": F.lit(False), **extra})
    counts = class_counts(df, target)
    if method == "none" or imbalance_ratio(counts) < preset.BALANCED_BELOW:
        return originals
    unknown = df.where(F.greatest(*[F.col(c).isNull() for c in features], F.lit(False))).limit(1).collect()
    if unknown:
        raise ValueError("features hold nulls; impute before resampling")
    short = rows_short(counts, strategy)
    if not short:
        return originals
    small = [c for c in short if counts[c] <= k]
    if small:
        raise ValueError(f"classes {small} have no {k} neighbours")
    minority = df.where(F.col(target).isin(list(short)))
    bases = {"smote": _smote_bases, "adasyn": _adasyn_bases, "borderline": _borderline_bases}[method](
        df, minority, target, row_id, features, short, k, seed
    )
    ensure_checkpoint_dir(df.sparkSession)
    bases = bases.where("reps > 0").checkpoint()
    members = as_points(minority, row_id, features, target)
    near = nearest_neighbours(members, k, bases.select("id")).join(bases.select("id", "reps"), "id")
    return originals.unionByName(_draw(near, df, target, row_id, features, seed, trace))


def _draw(near: DataFrame, df: DataFrame, target: str, row_id: str, features: Sequence[str], seed: int, trace: bool) -> DataFrame:
    """``reps`` synthetic rows per base. Many draws of one base are spread over tasks block by block."""
    blocks = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("reps") - 1) / DRAWS_PER_BLOCK).cast("int"))))
    spread = blocks.repartition(F.col("id"), F.col("block"))
    first = F.col("block").cast("bigint") * DRAWS_PER_BLOCK
    last = F.least(first + DRAWS_PER_BLOCK, F.col("reps")) - 1
    drawn = spread.withColumn("draw", F.explode(F.sequence(first, last)))
    keyed = drawn.withColumn("key", draw_key(F.col("id"), F.col("draw"), seed))
    pick = F.pmod(hex_slice(F.col("key"), 1), F.size("neighbours")) + 1
    picked = keyed.select(
        "id", "g", "vec", F.element_at("neighbours", pick.cast("int")).alias("to"), unit_draw(F.col("key"), 9).alias("lam")
    )

    def value(i: int, c: str) -> Column:
        a, b = F.col("vec")[i], F.col("to.vec")[i]
        return (a + F.col("lam") * (b - a)).alias(c)

    cols = [
        F.lit(None).cast(df.schema[row_id].dataType).alias(row_id), F.col("g").cast(df.schema[target].dataType).alias(target),
        *[value(i, c) for i, c in enumerate(features)], F.lit(True).alias("is_synthetic"),
    ]
    if trace:
        cols += [F.col("id").alias("base_id"), F.col("to.id").alias("neighbour_id")]
    return picked.select(*cols)


def _dealt(rows: DataFrame, target: str, row_id: str, wanted: dict, sizes: dict, seed: int) -> DataFrame:
    """Bases with their number of draws, dealt out evenly over ``rows``."""
    cuts = {c: [n % sizes[c]] for c, n in wanted.items() if n % sizes[c]}
    keys = cut_keys(rows.where(F.col(target).isin(list(cuts))), target, row_id, cuts, seed) if cuts else {}
    kind = rows.schema[target].dataType.simpleString()
    plan = [(c, n // sizes[c], keys[c][n % sizes[c]] if n % sizes[c] else "") for c, n in wanted.items()]
    side = rows.sparkSession.createDataFrame(plan, f"__c {kind}, __whole bigint, __cut string")
    more = F.when(order_key(F.col(row_id), seed) <= F.col("__cut"), 1).otherwise(0)
    return rows.join(F.broadcast(side), F.col(target) == F.col("__c")).select(
        F.col(row_id).alias("id"), F.col(target).cast("string").alias("g"), (F.col("__whole") + more).alias("reps")
    )


def _smote_bases(df, minority, target, row_id, features, short, k, seed) -> DataFrame:
    sizes = class_counts(minority, target)
    return _dealt(minority, target, row_id, short, sizes, seed)


def other_class_neighbours(df, minority, target, row_id, features, k) -> DataFrame:
    """How many of the k nearest rows of any class have another class, for each row of ``minority``."""
    points = as_points(df, row_id, features, tag=target)
    near = nearest_neighbours(points, k, minority.select(F.col(row_id).alias("id")))
    differs = F.filter("neighbours", lambda e: ~e["tag"].eqNullSafe(F.col("tag")))
    own = F.col("tag").cast(df.schema[target].dataType)
    return near.select("id", own.alias("own"), F.size(differs).alias("others"))


def _adasyn_bases(df, minority, target, row_id, features, short, k, seed) -> DataFrame:
    """More draws for rows among other classes: the class's missing rows in proportion to the share of such neighbours."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = other_class_neighbours(df, minority, target, row_id, features, k).checkpoint()
    totals = {r["own"]: r["s"] for r in seen.groupBy("own").agg(F.sum(F.col("others") / k).alias("s")).collect()}
    lonely = [c for c in short if not totals.get(c)]
    if lonely:
        raise ValueError(f"classes {lonely} have no neighbours of another class")
    kind = df.schema[target].dataType.simpleString()
    side = df.sparkSession.createDataFrame(
        [(c, float(totals[c]), float(n)) for c, n in short.items()], f"own {kind}, total double, missing double"
    )
    reps = F.rint(F.col("others") / k / F.col("total") * F.col("missing")).cast("bigint")
    return seen.join(F.broadcast(side), "own").select("id", F.col("own").cast("string").alias("g"), reps.alias("reps"))


def _borderline_bases(df, minority, target, row_id, features, short, k, seed) -> DataFrame:
    """Only rows of which half or more, but not all, of the nearest rows have another class; others are safe or noise."""
    m = BORDER_NEIGHBOURS
    ensure_checkpoint_dir(df.sparkSession)
    seen = other_class_neighbours(df, minority, target, row_id, features, m)
    danger = seen.where((F.col("others") >= m / 2) & (F.col("others") < m)).select("id", F.col("own").alias("c")).checkpoint()
    sizes = class_counts(danger, "c")
    wanted = {c: n for c, n in short.items() if c in sizes}
    if not wanted:
        return danger.select("id", F.col("c").cast("string").alias("g"), F.lit(0).cast("bigint").alias("reps"))
    return _dealt(danger, "c", "id", wanted, sizes, seed)


def resample_report(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Class sizes before and after, the change, and the ratio of largest to smallest."""
    b = before.groupBy(target).agg(F.count("*").alias("before"))
    a = after.groupBy(target).agg(F.count("*").alias("after"))
    joined = left_join_default(a, b, target, {"before": 0})
    whole = Window.partitionBy()

    def ratio(c: str) -> Column:
        return F.try_divide(F.max(c).over(whole).cast("double"), F.min(c).over(whole))

    return joined.select(
        F.col(target).alias("class"), "before", "after", (F.col("after") - F.col("before")).alias("change"),
        ratio("before").alias("ratio_before"), ratio("after").alias("ratio_after"),
    )
