"""Classification metrics from the confusion matrix, and curves from scores.

Every table may hold several models: ``by`` names the columns that tell them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas.functions.buckets import running_sums, with_range_bucket
from gravitas.functions.columns import percent
from gravitas.operators.reshape import all_pairs, union_all
from gravitas.session import ensure_checkpoint_dir

# Fixed value: smallest probability a logarithm is taken of, the spacing of doubles at 1.
SMALLEST = 2.220446049250313e-16

METRICS = ["Accuracy", "Balanced_Accuracy", "Precision", "Recall", "F1_Score", "Matthews_Corr", "Cohen_Kappa"]


def outcome_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per actual and predicted class: the one pass over the predictions that all class metrics need."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts over all pairs of classes, with the percent of each actual class; 0 where nothing was counted."""
    # The condition, always true, keeps the count in every branch: they share one aggregate of the predictions.
    counts = outcome_counts(df, actual, predicted, by).where("n > 0")
    classes = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).where("c is not null").distinct()
    models = counts.select(*by, F.lit(1).alias("__one")).distinct()
    rows = all_pairs(models, classes.withColumnRenamed("c", "actual"))
    grid = all_pairs(rows, classes.withColumnRenamed("c", "predicted")).drop("__one")
    full = grid.join(counts, [*by, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return full.withColumn("percent", percent(F.col("n"), total))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall and F1, 0 where undefined."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )
    per = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return per.withColumns(
        {
            "precision": share(F.col("hits"), F.col("predicted")),
            "recall": share(F.col("hits"), F.col("support")),
            "f1": share(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )


def summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All seven class metrics, one row per model."""
    t, p, h = F.col("support").cast("double"), F.col("predicted").cast("double"), F.col("hits").cast("double")
    sums = class_scores(counts, by).groupBy(*by).agg(
        F.sum(t).alias("s"), F.sum(h).alias("c"),
        F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"),
        F.avg(F.when(t > 0, F.col("recall"))).alias("balanced"),
        *[F.sum(t * F.col(m)).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
    )
    s, c, tp = F.col("s"), F.col("c"), F.col("tp")
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    chance = tp / (s * s)
    return sums.select(
        *by,
        (c / s).alias("Accuracy"),
        F.col("balanced").alias("Balanced_Accuracy"),
        (F.col("w_precision") / s).alias("Precision"),
        (F.col("w_recall") / s).alias("Recall"),
        (F.col("w_f1") / s).alias("F1_Score"),
        F.coalesce(F.try_divide(c * s - tp, spread), F.lit(0.0)).alias("Matthews_Corr"),
        F.try_divide(c / s - chance, F.lit(1.0) - chance).alias("Cohen_Kappa"),
    )


def metric(df: DataFrame, actual: str, predicted: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return summary(outcome_counts(df, actual, predicted, by), by).select(*by, *names)


def log_loss(df: DataFrame, actual_index: str, probabilities: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative logarithm of the probability given to the actual class, by its position in the array."""
    given = F.try_element_at(probabilities, F.col(actual_index).cast("int") + 1)
    return df.groupBy(*by).agg((-F.avg(F.log(F.greatest(given, F.lit(SMALLEST))))).alias("Log_Loss"))


def classification_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro average and weighted average."""
    per = class_scores(outcome_counts(df, actual, predicted, by), by)
    weight = F.col("support").cast("double")
    rows = per.select(*by, F.col("class").cast("string").alias("label"), "precision", "recall", "f1", weight.alias("support"))

    def total(label: str, *values: Column) -> DataFrame:
        names = ("precision", "recall", "f1", "support")
        return per.groupBy(*by).agg(*[v.alias(n) for v, n in zip(values, names)]).select(*by, F.lit(label).alias("label"), *names)

    accuracy = F.sum(F.col("hits").cast("double")) / F.sum(weight)
    macro = total("macro avg", *[F.avg(m) for m in ("precision", "recall", "f1")], F.sum(weight))
    mean = total("weighted avg", *[F.sum(weight * F.col(m)) / F.sum(weight) for m in ("precision", "recall", "f1")], F.sum(weight))
    return union_all(rows, total("accuracy", accuracy, accuracy, accuracy, accuracy), macro, mean)


def one_vs_rest(df: DataFrame, actual_index: str, probabilities: Column, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per model, class and distinct score, added up before the shuffle."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("class"), probabilities[k].alias("score"), (F.col(actual_index) == k).alias("hit"))
            for k in range(n_classes)
        ]
    )
    long = df.select(*by, F.inline(rows))
    return long.groupBy(*by, "class", "score").agg(
        F.count(F.when(F.col("hit"), 1)).alias("pos"), F.count(F.when(~F.col("hit"), 1)).alias("neg")
    )


def roc_cumulative(scores: DataFrame, by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """True and false positives at each distinct score, from the highest down.

    The scores are written down first: ranges and sums need several passes, and the predictions are scored only once.
    """
    return _cumulated(scores, by, rows_per_bucket).drop("bucket")


def _cumulated(scores: DataFrame, by: Sequence[str], rows_per_bucket: int | None) -> DataFrame:
    ensure_checkpoint_dir(scores.sparkSession)
    ranged = with_range_bucket(scores.checkpoint(), "score", rows_per_bucket=rows_per_bucket)
    group = [*by, "class"]
    return running_sums(ranged, group, "bucket", F.col("score").desc(), {"tp": "pos", "fp": "neg"}, descending=True)


def with_next_step(cumulated: DataFrame, group: Sequence[str]) -> DataFrame:
    """``step``: positives and negatives at the next lower score, null at the lowest.

    Inside a range the next row has it; a range's last row takes it from the highest score of the next range that has
    rows. Only one row per range is ever sorted over ranges.
    """
    inner = Window.partitionBy(*group, "bucket").orderBy(F.col("score").desc_nulls_last())
    step = F.struct("pos", "neg")
    tops = cumulated.groupBy(*group, "bucket").agg(F.max_by(step, F.coalesce("score", F.lit(float("-inf")))).alias("top"))
    after = Window.partitionBy(*group).orderBy(F.col("bucket").desc())
    following = tops.select(*[F.col(c).alias(f"__g_{c}") for c in [*group, "bucket"]], F.lead("top").over(after).alias("__after"))
    same = F.lit(True)
    for c in [*group, "bucket"]:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    joined = cumulated.withColumn("__inside", F.lead(step).over(inner)).join(following, same)
    return joined.withColumn("step", F.coalesce("__inside", "__after")).drop("__inside", "__after", *[f"__g_{c}" for c in [*group, "bucket"]])


def roc_points(scores: DataFrame, by: Sequence[str] = (), rows_per_bucket: int | None = None, thinned: bool = True) -> DataFrame:
    """Rates at distinct scores; the corner (0, 0) belongs to no score.

    Unless told otherwise, scores between two others on one straight line are left out: those whose positives and
    negatives stand in the same ratio as at the next lower score. The highest and the lowest score always stay.
    """
    group = [*by, "class"]
    cumulated = _cumulated(scores, by, rows_per_bucket)
    sums = cumulated.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if thinned:
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        turns = wide("pos") * wide("step.neg") != wide("neg") * wide("step.pos")
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        cumulated = with_next_step(cumulated, group).where(F.col("step").isNull() | first | turns)
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    points = cumulated.join(F.broadcast(sums.withColumnsRenamed({c: f"__s_{c}" for c in group})), same)
    rated = points.select(
        *group, "score", F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )
    corner = sums.select(*group, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return rated.unionByName(corner)


def roc_auc(scores: DataFrame, by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Trapezoid area per class. Each score's trapezoid needs only its own counts and the running total."""
    group = [*by, "class"]
    cumulated = roc_cumulative(scores, by, rows_per_bucket)
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return cumulated.groupBy(*group).agg(
        F.try_divide(area, F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc")
    )


def confidence(probabilities: Column) -> Column:
    """High above 0.7, Medium above 0.5, else Low, for the largest probability."""
    top = F.array_max(probabilities)
    return F.when(top > 0.7, "High").when(top > 0.5, "Medium").otherwise("Low")
