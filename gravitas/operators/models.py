"""Classifiers from MLlib: weights, training, cross-validation, tuning, importances."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.operators import metrics
from gravitas.operators.forest import GrownForest, can_grow, grow_forest
from gravitas.operators.split import class_counts, stratified_folds
from gravitas.session import cached, ensure_checkpoint_dir, removed, written

LABEL, FEATURES, WEIGHT = "label", "features", "class_weight"

# Iterations, depths and sizes of the three classifiers. MLlib trees are at most 30 deep.
LOGISTIC_ITERATIONS = 1000
TREE_DEPTH = 10
FOREST_TREES = 100
DEEPEST = 30
#: Nodes of a forest that a task holds at a time to score rows; larger forests are scored some trees after the others.
SCORED_NODES = 250_000
#: Up to so many training rows stay in the parts they are read in; more are dealt to all cores, with at most so many in a part.
SPREAD_FROM = 100_000
PART_ROWS = 1_000_000


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    facts = counted.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counted.withColumn("f", facts).select(
        "class", "n", (F.col("f.rows").cast("double") / (F.col("f.classes") * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, target: str, counts: Mapping | None = None) -> DataFrame:
    """The weight of each row's class as a column of literals; the number of classes is checked when counting."""
    counts = class_counts(df, target) if counts is None else counts
    rows = sum(counts.values())
    weight: Column = F.lit(None).cast("double")
    for c, n in counts.items():
        weight = F.when(F.col(target) == F.lit(c), F.lit(rows / (len(counts) * n))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


@dataclass
class Profile:
    """One of the two ways the models are trained: weighted by class or not, and how deep the trees are."""

    balanced: bool = True
    tree_depth: int = TREE_DEPTH
    forest_trees: int = FOREST_TREES
    forest_depth: int = DEEPEST


# The settings of the training job and of the two interactive trainings.
JOB = Profile()
PAGE = Profile(balanced=False, tree_depth=15, forest_trees=100, forest_depth=15)
ADHOC = Profile(balanced=False, tree_depth=10, forest_trees=50, forest_depth=10)


def define_models(n_rows: int, profile: Profile = JOB, seed: int = preset.SEED, max_bins: int = 64) -> dict[str, Estimator]:
    """The three classifiers. The penalty 1 / rows gives the same objective as an inverse strength C of 1,
    because balanced weights add up to the number of rows."""
    common = {"labelCol": LABEL, "featuresCol": FEATURES}
    if profile.balanced:
        common["weightCol"] = WEIGHT
    deep = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}
    return {
        "Logistic Regression": LogisticRegression(
            family="multinomial", maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0,
            standardization=False, **common,
        ),
        "Decision Tree": DecisionTreeClassifier(maxDepth=profile.tree_depth, maxBins=max_bins, seed=seed, **common),
        "Random Forest": RandomForestClassifier(
            numTrees=profile.forest_trees, maxDepth=profile.forest_depth, maxBins=max_bins, featureSubsetStrategy="sqrt",
            seed=seed, **deep, **common,
        ),
    }


@dataclass
class Prepared:
    """A table ready for fitting: assembled features, label index and weight."""

    frame: DataFrame
    features: list[str]
    indexer: StringIndexerModel
    n_rows: int

    @property
    def classes(self) -> list[str]:
        return list(self.indexer.labels)


def label_indexer(target: str) -> StringIndexer:
    return StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="error")


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error")


def spread(df: DataFrame, rows: int, by: Sequence[str]) -> DataFrame:
    """Many rows in even parts, a multiple of the cores, so that each pass of a fit keeps all cores busy.

    Parts of files go by bytes, and a row has few bytes in a file for the work it makes. Bootstraps are drawn by place,
    so the order of rows in a part follows from the rows.
    """
    if rows <= SPREAD_FROM:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * math.ceil(rows / (cores * PART_ROWS)), *by).sortWithinPartitions(*by)


def prepare(
    df: DataFrame, target: str, features: Sequence[str], indexer: StringIndexerModel | None = None, row_id: str = "event_id"
) -> Prepared:
    """Add features, label index and class weight; the id is carried along if there is one."""
    ensure_checkpoint_dir(df.sparkSession)
    fitted = indexer or label_indexer(target).fit(df)
    carried = [c for c in (row_id, "fold") if c in df.columns]
    counts = class_counts(df, target)
    even = spread(df, sum(counts.values()), [*carried, target, *features])
    weighted = with_class_weight(even, target, counts)
    frame = assembler(features).transform(fitted.transform(weighted)).select(*carried, target, LABEL, WEIGHT, FEATURES)
    return Prepared(frame, list(features), fitted, df.count())


@dataclass
class Trained:
    models: dict[str, object] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)


def fit_model(train: Prepared, frame: DataFrame, est: Estimator):
    """Fit one model on the rows of ``train``, kept as ``frame``; forests on many rows are grown as in ``forest``."""
    grown = grow_forest(est, frame, len(train.classes)) if can_grow(est, train.n_rows, len(train.classes)) else None
    return est.fit(frame) if grown is None else grown


def fit_all(train: Prepared, estimators: Mapping[str, Estimator]) -> Trained:
    """Fit the models one after the other; the assembled rows are kept while that takes."""
    out = Trained()
    with cached(train.frame) as frame:
        for name, est in estimators.items():
            start = time.time()
            out.models[name] = fit_model(train, frame, est)
            out.log.append((name, time.time() - start, train.n_rows, len(train.features), len(train.classes)))
    return out


def training_log(df: DataFrame, trained: Trained, test_rows: int) -> DataFrame:
    rows = [(n, t, r, test_rows, f, c) for n, t, r, f, c in trained.log]
    return df.sparkSession.createDataFrame(
        rows, "Model string, Training_Time double, train_samples long, test_samples long, features long, classes long"
    ).withColumn("timestamp", F.current_timestamp())


def tree_groups(model: RandomForestClassificationModel) -> list[list[DecisionTreeClassificationModel]]:
    """The trees in order, cut into groups of at most ``SCORED_NODES`` nodes, or of one tree that has more."""
    groups: list[list[DecisionTreeClassificationModel]] = []
    held = 0
    for tree in model.trees:
        if not groups or held + tree.numNodes > SCORED_NODES:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += tree.numNodes
    return groups


def scored_by_trees(model: RandomForestClassificationModel, data: DataFrame) -> DataFrame:
    """``label, prediction, probability`` as the whole forest gives them, without a task that holds all of its trees.

    A transformer travels with every task of every job that uses it, so that a deep forest takes longer to arrive than
    to score. Each group of trees adds its shares to those of the groups before, in the order of the trees, and the sums
    are written down; whatever reads the result needs no tree.
    """
    spark, groups, before = data.sparkSession, tree_groups(model), None
    votes = data.select(LABEL, FEATURES, F.array_repeat(F.lit(0.0), model.numClasses).alias("votes"))
    for at, trees in enumerate(groups):
        shares = [f"__share{i}" for i in range(len(trees))]
        for tree, share in zip(trees, shares):
            names = {tree.featuresCol: FEATURES, tree.rawPredictionCol: "", tree.predictionCol: "", tree.probabilityCol: share}
            votes = tree.transform(votes, names)
        each = F.array(*[vector_to_array(s) for s in shares])
        added = F.aggregate(each, F.col("votes"), lambda total, share: F.zip_with(total, share, lambda a, b: a + b))
        kept = [LABEL, FEATURES] if at + 1 < len(groups) else [LABEL]
        votes, path = written(votes.select(*kept, added.alias("votes")), "votes")
        if before is not None:
            removed(spark, before)
        before = path
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
    return votes.select(
        LABEL, (F.array_position("votes", F.array_max("votes")) - 1).cast("double").alias("prediction"),
        F.transform("votes", lambda x: x / total).alias("probability"),
    )


def scored(model, data: DataFrame) -> DataFrame:
    """``label, prediction, probability`` by one model."""
    if isinstance(model, GrownForest):
        return model.scored(data)
    if isinstance(model, RandomForestClassificationModel) and model.totalNumNodes > SCORED_NODES:
        return scored_by_trees(model, data)
    return model.transform(data).select(LABEL, "prediction", vector_to_array("probability").alias("probability"))


def predict_all(trained: Trained, data: DataFrame) -> DataFrame:
    """Predictions of all models on one table, told apart by ``Model``."""
    out = None
    for name, model in trained.models.items():
        told = scored(model, data).select(
            F.lit(name).alias("Model"), F.col(LABEL).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), "probability",
        )
        out = told if out is None else out.unionByName(told)
    if out is None:
        raise ValueError("no models")
    return out


def evaluate(predictions: DataFrame, by: Sequence[str] = ("Model",)) -> DataFrame:
    """The class metrics and the log loss of each model."""
    by = list(by)
    scores = metrics.summary(metrics.outcome_counts(predictions, "actual", "predicted", by), by)
    loss = metrics.log_loss(predictions, "actual", F.col("probability"), by)
    return scores.join(loss, by)


def train_and_evaluate(train: Prepared, test: DataFrame, estimators: Mapping[str, Estimator], validation: DataFrame | None = None):
    """Fit every model, score test and validation; the table of results, the fitted models and the predictions."""
    trained = fit_all(train, estimators)
    predictions = predict_all(trained, test)
    spark = train.frame.sparkSession
    times = spark.createDataFrame([(n, t) for n, t, *_ in trained.log], "Model string, Training_Time double")
    results = times.join(evaluate(predictions), "Model")
    if validation is not None:
        val = metrics.metric(predict_all(trained, validation), "actual", "predicted", ["Accuracy", "Precision", "Recall", "F1_Score"], ["Model"])
        renamed = {"Accuracy": "Val_Accuracy", "Precision": "Val_Precision", "Recall": "Val_Recall", "F1_Score": "Val_F1"}
        results = results.join(val.withColumnsRenamed(renamed), "Model")
    # A row per model, asked for again and again: scored once.
    return spark.createDataFrame(results.collect(), results.schema), trained, predictions


#: From the rows that are fitted on to the models: their penalty depends on it.
ModelMaker = Callable[[int], Mapping[str, Estimator]]


def fold_parts(ready: Prepared, frame: DataFrame, folds: int) -> list[tuple[Prepared, DataFrame]]:
    """For each fold the rows to fit on, with balanced weights of these rows alone, and those held back.

    One count per fold and class gives all weights; a class that only the held rows have weighs nothing.
    """
    counts: dict[int, dict[float, int]] = {}
    for r in frame.groupBy("fold", LABEL).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["fold"], {})[r[LABEL]] = r["n"]
    out = []
    for i in range(folds):
        sizes: dict[float, int] = {}
        for fold, per in counts.items():
            for label, n in per.items():
                sizes[label] = sizes.get(label, 0) + n * (fold != i)
        rows, present = sum(sizes.values()), sum(n > 0 for n in sizes.values())
        weight = F.element_at(F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (float(label), rows / (present * n) if n else 0.0)]), F.col(LABEL))
        fitted_on = frame.where(F.col("fold") != i).withColumn(WEIGHT, weight)
        out.append((Prepared(fitted_on, ready.features, ready.indexer, rows), frame.where(F.col("fold") == i)))
    return out


def fold_scores(df: DataFrame, target: str, row_id: str, features: Sequence[str], make: ModelMaker, folds: int = 5, parallel: int = 2) -> DataFrame:
    """``Model, fold`` and the metrics of each; ``make`` gives the models for a number of rows.

    Weights and penalty follow from the rows a fold is fitted on. The assembled rows are kept while all models and folds
    are fitted, ``parallel`` fits at a time. Metrics come from one confusion matrix per model and fold.
    """
    ready = prepare(stratified_folds(df, target, row_id, folds), target, features)
    with cached(ready.frame) as frame:
        jobs = [(i, name, est, part, held) for i, (part, held) in enumerate(fold_parts(ready, frame, folds)) for name, est in make(part.n_rows).items()]

        def counted(job) -> list[tuple]:
            i, name, est, part, held = job
            trained = Trained({name: fit_model(part, part.frame, est)})
            rows = metrics.outcome_counts(predict_all(trained, held), "actual", "predicted").collect()
            return [(name, i, r["actual"], r["predicted"], r["n"]) for r in rows]

        with ThreadPoolExecutor(parallel) as pool:
            rows = [row for each in pool.map(counted, jobs) for row in each]
    by = ["Model", "fold"]
    counts = df.sparkSession.createDataFrame(rows, "Model string, fold int, actual int, predicted int, n bigint")
    return metrics.summary(counts, by).select(*by, "Accuracy", "Precision", "Recall", "F1_Score")


def cross_validate(df: DataFrame, target: str, row_id: str, features: Sequence[str], make: ModelMaker, folds: int = 5, parallel: int = 2) -> DataFrame:
    """Mean and deviation of the metrics of all models over the folds, see ``fold_scores``."""
    return cv_summary(fold_scores(df, target, row_id, features, make, folds, parallel))


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    aggs = []
    for m, short in (("Accuracy", "Accuracy"), ("Precision", "Precision"), ("Recall", "Recall"), ("F1_Score", "F1")):
        aggs += [F.avg(m).alias(f"CV_{short}_Mean"), F.stddev_pop(m).alias(f"CV_{short}_Std")]
    return per_fold.groupBy("Model").agg(*aggs)


#: Settings that the search tries. ``C`` divides the penalty, the other names are those of the classifier.
GRID: dict[str, list[dict[str, float]]] = {
    "Logistic Regression": [{"C": c} for c in (0.1, 1.0, 10.0)],
    "Decision Tree": [{"maxDepth": depth} for depth in (3, 5, 10)],
    "Random Forest": [{"maxDepth": depth, "numTrees": trees} for depth in (5, 10) for trees in (20, 50)],
}


def with_settings(estimator: Estimator, settings: Mapping[str, float]) -> Estimator:
    """A copy of the classifier with other settings."""
    named = {k: v for k, v in settings.items() if k != "C"}
    if "C" in settings:
        named["regParam"] = estimator.getOrDefault("regParam") / settings["C"]
    return estimator.copy({estimator.getParam(k): v for k, v in named.items()})


def settings_text(settings: Mapping[str, float]) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(settings.items()))


def tune(
    df: DataFrame, target: str, row_id: str, features: Sequence[str], make: ModelMaker,
    grid: Mapping[str, Sequence[Mapping[str, float]]] = GRID, folds: int = 5, parallel: int = 2,
) -> DataFrame:
    """``Model, params, Best_Score, is_best``: mean F1 over the folds for all settings of all models.

    All settings share the assembled rows, the folds and their weights; see ``fold_scores``. Of settings that are
    equally good the one named first is the best. Models without settings in ``grid`` are left out.
    """
    tried = {f"{name}: {settings_text(s)}": (name, s) for name, each in grid.items() for s in each}

    def candidates(n_rows: int) -> dict[str, Estimator]:
        base = make(n_rows)
        return {label: with_settings(base[name], s) for label, (name, s) in tried.items() if name in base}

    scores = fold_scores(df, target, row_id, features, candidates, folds, parallel)
    means = scores.groupBy(F.col("Model").alias("label")).agg(F.avg("F1_Score").alias("Best_Score"))
    rows = [(label, name, settings_text(s), i) for i, (label, (name, s)) in enumerate(tried.items())]
    named = df.sparkSession.createDataFrame(rows, "label string, Model string, params string, no int")
    place = F.row_number().over(Window.partitionBy("Model").orderBy(F.round("Best_Score", 12).desc(), "no"))
    return named.join(means, "label").select("Model", "params", "Best_Score", (place == 1).alias("is_best"))


def feature_importance(spark, trained: Trained, features: Sequence[str], k: int = 20) -> DataFrame:
    """The k largest importances of each tree model."""
    from gravitas.operators.ranking import top_features

    rows = []
    for name, model in trained.models.items():
        if hasattr(model, "featureImportances"):
            rows += [(name, f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return top_features(spark.createDataFrame(rows, "Model string, Feature string, Importance double"), k)


def feature_coefficients(spark, model, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Coefficients by size: the top 20 of two classes, else the top 15 of each of the first three classes."""
    matrix = model.coefficientMatrix.toArray()
    binary = len(classes) == 2
    # With two classes the multinomial form has a row per class; their difference is the binary coefficient.
    picked = [(classes[-1], matrix[-1] - matrix[0] if len(matrix) == 2 else matrix[0])] if binary else list(zip(classes[:3], matrix[:3]))
    rows = [(c, f, float(x)) for c, line in picked for f, x in zip(features, line)]
    table = spark.createDataFrame(rows, "class string, Feature string, Coefficient double")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.abs("Coefficient").desc(), "Feature"))
    return table.withColumn("place", place).where(F.col("place") <= (20 if binary else 15))


def as_pipeline(ready: Prepared, model) -> PipelineModel:
    """Assembler and classifier as one saved unit that scores a plain feature table."""
    return PipelineModel([assembler(ready.features), model.mllib if isinstance(model, GrownForest) else model])


