"""Comparison, ranking and selection of models from their table of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravitas.functions.columns import count_where
from gravitas.operators.distributions import describe_numeric
from gravitas.operators.reshape import arg_max, average_rank, unpivot

# Metrics that models are compared, ranked and reported by.
COMPARED = ["Accuracy", "Precision", "Recall", "F1_Score", "Balanced_Accuracy"]
REPORTED = ["Accuracy", "F1_Score", "Precision", "Recall"]
SIMILAR_SPREAD = 0.05
WEAK_BELOW = 0.8
UNSTABLE_ABOVE = 0.05


def compare_models(results: DataFrame) -> DataFrame:
    """One row per model and metric, next to the training time."""
    have = [m for m in COMPARED if m in results.columns]
    times = ["Training_Time"] if "Training_Time" in results.columns else []
    return unpivot(results, ["Model", *times], have, "metric", "value")


def model_ranking(results: DataFrame) -> DataFrame:
    """Average of the ranks over the metrics, equal values sharing theirs, and the rank of that average."""
    have = [m for m in COMPARED if m in results.columns]
    # Nine digits tell models apart; noise in the last digits of a sum does not.
    ranked = results.select("Model", *[average_rank(F.round(m, 9), []).alias(f"{m}_Rank") for m in have])
    total = sum((F.col(f"{m}_Rank") for m in have), F.lit(0.0))
    averaged = ranked.withColumn("Average_Rank", total / len(have))
    return averaged.withColumn("Overall_Rank", average_rank(F.round("Average_Rank", 9), [], descending=False))


def select_best_model(results: DataFrame, metric: str = "F1_Score") -> DataFrame:
    """The model with the highest value of a metric; the first name on a tie."""
    if metric not in results.columns:
        have = [c for c in results.columns if c not in ("Model", "Training_Time")]
        raise ValueError(f"metric {metric!r} not found; available: {have}")
    return results.agg(F.lit(metric).alias("metric"), arg_max("Model", F.round(metric, 9)).alias("Model"), F.max(metric).alias("score"))


def best_per_metric(results: DataFrame) -> DataFrame:
    """The best model and its score for each reported metric."""
    long = unpivot(results, ["Model"], [m for m in REPORTED if m in results.columns], "metric", "value")
    return long.groupBy("metric").agg(arg_max("Model", F.round("value", 9)).alias("Model"), F.max("value").alias("score"))


def training_time_summary(log: DataFrame) -> DataFrame:
    t = F.col("Training_Time")
    return log.agg(
        F.sum(t).alias("total_time"),
        F.avg(t).alias("mean_time"),
        F.min_by("Model", F.struct(t, F.col("Model"))).alias("fastest"),
        F.min(t).alias("fastest_time"),
        arg_max("Model", "Training_Time").alias("slowest"),
        F.max(t).alias("slowest_time"),
    )


def top_features(importances: DataFrame, k: int, by: str = "Model") -> DataFrame:
    """The k features of each model with the largest importance."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.round("Importance", 9).desc(), "Feature"))
    return importances.withColumn("__p", place).where(F.col("__p") <= k).drop("__p")


def mean_importance_top5(importances: DataFrame, listed: int = 10, k: int = 5) -> DataFrame:
    """Mean importance of a feature over the lists it is on; a list without it does not count as 0."""
    means = top_features(importances, listed).groupBy("Feature").agg(F.avg("Importance").alias("Importance"))
    return means.orderBy(F.round("Importance", 9).desc(), "Feature").limit(k)


def model_advice(results: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """What the results suggest: whether models are alike or weak, the most efficient, and unstable ones."""
    f1 = F.col("F1_Score")
    efficiency = F.round(F.try_divide(f1, F.col("Training_Time")), 9)
    advice = results.agg(
        (F.max(f1) - F.min(f1) < SIMILAR_SPREAD).alias("similar"),
        (F.max(f1) < WEAK_BELOW).alias("weak"),
        arg_max("Model", efficiency).alias("most_efficient"),
    )
    if cv is None:
        return advice
    unstable = F.filter(
        F.sort_array(F.collect_list(F.when(F.col("CV_F1_Std") > UNSTABLE_ABOVE, F.col("Model")))), lambda m: m.isNotNull()
    )
    facts = cv.agg(
        F.struct(
            F.array_join(unstable, ", ").alias("unstable"),
            arg_max("Model", F.round("CV_F1_Mean", 9)).alias("best"),
            F.max("CV_F1_Mean").alias("score"),
            count_where(F.col("CV_F1_Std") > UNSTABLE_ABOVE).alias("n"),
        ).alias("f")
    ).scalar()
    return advice.withColumn("f", facts).select(
        "similar", "weak", "most_efficient", F.col("f.unstable").alias("unstable"), F.col("f.n").alias("n_unstable"),
        F.col("f.best").alias("best_cv_model"), F.col("f.score").alias("best_cv_f1"),
    )


def results_describe(results: DataFrame, cols: Sequence[str]) -> DataFrame:
    return describe_numeric(results, cols)
