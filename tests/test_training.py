"""Training, selection, saving and scoring with MLlib on the accident table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gravitas.functions.columns import rounded
from gravitas.operators import models, ranking, resample
from gravitas.plans import catalog, model_queries
from gravitas.plans.model_queries import INPUTS, model_rows
from gravitas.plans.prepare import Preparation, prepare_splits
from gravitas.plans.profile import Profile
from gravitas.plans.training import Training
from gravitas.session import fresh_path
from gravitas.sources import sinks, tables
from gravitas.sources.sinks import folder_name
from gravitas.streaming import saved, score

T = "most_severe_injury"


@pytest.fixture(scope="module")
def done(spark, sf):
    return prepare_splits(model_rows(spark, sf))


@pytest.fixture(scope="module")
def run(done):
    r = Training(done.parts["train"], done.parts["test"], done.fitted.features, T, done.parts["validation"])
    r.define_models(models.Profile(tree_depth=5, forest_trees=5, forest_depth=5))
    r.train_and_evaluate()
    return r


def test_test_rows_reach_no_fit(done, acc):
    ids = {n: {r.event_id for r in df.select("event_id").collect()} for n, df in done.parts.items()}
    assert not ids["train"] & ids["test"] and not ids["train"] & ids["validation"]
    assert len(ids["train"] | ids["test"] | ids["validation"]) == acc.count()


def test_resampling_touches_only_training_rows(spark, sf, done):
    balanced = prepare_splits(model_rows(spark, sf), method="smote")
    assert balanced.parts["test"].count() == done.parts["test"].count()
    sizes = {r["count"] for r in balanced.parts["train"].groupBy(T).count().collect()}
    assert len(sizes) == 1


def test_results_have_every_metric(run):
    rows = run.results.collect()
    assert {r.Model for r in rows} == {"Logistic Regression", "Decision Tree", "Random Forest"}
    for r in rows:
        assert 0 <= r.Accuracy <= 1 and r.Accuracy == pytest.approx(r.Recall) and r.Log_Loss > 0
        assert 0 <= r.Val_F1 <= 1 and r.Training_Time > 0


def test_balanced_weights_add_up_to_the_rows(run):
    row = run.ready.frame.agg(F.sum(models.WEIGHT).alias("w"), F.count("*").alias("n")).first()
    assert row.w == pytest.approx(row.n)


def test_same_seed_same_model(run):
    tree = models.define_models(run.ready.n_rows, models.Profile(tree_depth=5))["Decision Tree"]
    assert tree.fit(run.ready.frame).toDebugString.split("\n")[1:] == tree.fit(run.ready.frame).toDebugString.split("\n")[1:]


def test_report_and_selection(spark, run):
    report = run.generate_analysis_report()
    assert {r.metric for r in report["best_per_metric"].collect()} == set(ranking.REPORTED)
    assert report["ranking"].count() == 3
    best = run.get_best_model_name()
    info = run.save_best_model(fresh_path(spark, "models")).first()
    assert info.model_name == best and info.feature_count == len(run.features)


def test_cross_validation(run):
    run.define_models(models.Profile(tree_depth=3), ["Decision Tree"])
    row = run.perform_cross_validation("event_id", 3).first()
    assert 0 < row.CV_Accuracy_Mean <= 1 and row.CV_F1_Std >= 0


def test_stream_scores_like_batch(spark, sf):
    queries = catalog.queries()
    batch = queries["score_batch"](spark, sf)
    stream = queries["score_stream"](spark, sf)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    assert set(batch.columns) == {"event_id", "predicted", "max_probability", "confidence"}


def test_catalog_lists_models_without_description(spark, sf):
    rows = {r.name: r for r in catalog.queries()["model_catalog"](spark, sf).collect()}
    assert rows.pop("undescribed").model_name is None
    (best,) = rows.values()
    assert best.selection_metric == "F1_Score" and best.model_name in models.GRID and folder_name(best.model_name) == best.name


def test_large_forest_is_scored_some_trees_at_a_time(spark, monkeypatch):
    """Groups of trees give the same votes as the forest, and what they return reads no tree."""
    rows = [(float(i % 3), float(i * 7 % 11), float(i * 5 % 13)) for i in range(300)]
    data = models.assembler(["x", "y"]).transform(spark.createDataFrame(rows, f"{models.LABEL} double, x double, y double"))
    model = models.RandomForestClassifier(numTrees=7, maxDepth=5, seed=3, featuresCol=models.FEATURES, labelCol=models.LABEL).fit(data)
    whole = models.scored(model, data).collect()
    monkeypatch.setattr(models, "SCORED_NODES", max(t.numNodes for t in model.trees) * 2)
    assert 1 < len(models.tree_groups(model)) < 7 and [t.numNodes for g in models.tree_groups(model) for t in g] == [t.numNodes for t in model.trees]
    apart = models.scored(model, data)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, whole))
    assert "UDF" not in apart._jdf.queryExecution().executedPlan().toString()


def test_many_training_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """One part of a file is fitted on by all cores; the same rows lie in the same order each time, copies and nulls too."""
    cores = spark.sparkContext.defaultParallelism
    rows = [(None if i % 50 == 0 else i // 2, "ab"[i % 2], float(i // 4 % 7)) for i in range(4000)]
    one = spark.createDataFrame(rows, "event_id long, kind string, x double").coalesce(1)
    few = models.prepare(one, "kind", ["x"]).frame
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "SPREAD_FROM", 1000)
    ready = models.prepare(one, "kind", ["x"])
    sizes = [len(part) for part in ready.frame.rdd.glom().collect()]
    assert ready.n_rows == 4000 and len(sizes) == cores and max(sizes) <= 2 * 4000 / cores
    assert ready.frame.exceptAll(few).isEmpty() and few.exceptAll(ready.frame).isEmpty()
    turned = models.prepare(one.orderBy(F.desc("event_id"), "kind"), "kind", ["x"]).frame
    assert list(map(repr, turned.collect())) == list(map(repr, ready.frame.collect()))
    monkeypatch.setattr(models, "PART_ROWS", 4000 // cores // 2)
    assert models.prepare(one, "kind", ["x"]).frame.rdd.getNumPartitions() == 2 * cores


def test_coefficients_and_importances(spark, sf):
    coefficients = catalog.queries()["feature_coefficients"](spark, sf)
    assert coefficients.select("class").distinct().count() == 3
    importance = catalog.queries()["feature_importance"](spark, sf)
    totals = {r["Model"]: r["s"] for r in importance.groupBy("Model").agg(F.sum("Importance").alias("s")).collect()}
    assert totals == {"Decision Tree": pytest.approx(1.0, abs=1e-4), "Random Forest": pytest.approx(1.0, abs=1e-4)}


def test_settings_replace_those_of_the_model():
    every = models.define_models(50)
    assert models.with_settings(every["Logistic Regression"], {"C": 10.0}).getRegParam() == pytest.approx(0.002)
    forest = models.with_settings(every["Random Forest"], {"maxDepth": 4, "numTrees": 7})
    assert (forest.getMaxDepth(), forest.getNumTrees(), forest.getWeightCol()) == (4, 7, models.WEIGHT)


def test_search_over_all_models(spark, acc):
    """One best setting per model; the fitted ones join the results and the best of all is saved."""
    done = prepare_splits(acc.select(*INPUTS))
    run = Training(done.parts["train"], done.parts["test"], done.fitted.features, T)
    run.define_models(models.ADHOC)
    grid = {"Decision Tree": [{"maxDepth": 1}, {"maxDepth": 6}], "Logistic Regression": [{"C": 1.0}, {"C": 0.0001}], "Random Forest": [{"maxDepth": 3, "numTrees": 3}]}
    rows = run.tune_hyperparameters("event_id", grid, 3).collect()
    assert len(rows) == 5 and {r.Model: r.params for r in rows if r.is_best}["Decision Tree"] == "maxDepth=6"
    assert all(r.is_best == (r.Best_Score == max(x.Best_Score for x in rows if x.Model == r.Model)) for r in rows)
    assert {r.Model for r in run.results.collect()} == {f"{n} (Tuned)" for n in grid}
    saved_as = run.save_best_model(fresh_path(spark, "models")).first()
    assert saved_as.model_name == run.get_best_model_name() and saved_as.model_name.endswith("(Tuned)")


def test_stream_goes_on_where_it_stopped(spark, sf, tmp_path):
    """A file that arrives between two runs is scored by a scorer loaded in another session; no row twice."""
    rows = model_queries.model_rows(spark, sf)
    half = F.col("event_id") % 2
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    apply = model_queries.scorer(spark, sf)
    want = rounded(apply(rows))
    rows.where(half == 0).write.parquet(path)
    assert score.score_stream(spark, path, rows.schema, apply, out, at).count() == rows.where(half == 0).count()
    rows.where(half == 1).write.mode("append").parquet(path)
    other = spark.newSession()
    again = saved.load_scorer(other, model_queries.SCORERS[spark.sparkContext.applicationId, sf])
    score.score_stream(other, path, rows.schema, again, out, at)
    got = rounded(spark.read.parquet(out))
    assert got.count() == got.select("event_id").distinct().count() == rows.count()
    assert got.exceptAll(want).count() == 0


def test_rows_short_by_strategy():
    counts = {"a": 10, "b": 4, "c": 6}
    assert resample.rows_short(counts) == resample.rows_short(counts, "all") == {"b": 6, "c": 4}
    assert resample.rows_short(counts, "minority") == {"b": 6} and resample.rows_short(counts, "not minority") == {"c": 4}
    assert resample.rows_short(counts, {"c": 9, "a": 10}) == {"c": 3}
    assert resample.rows_short({"a": 10, "b": 4}, 0.75) == {"b": 3}
    for bad in ({"b": 3}, {"z": 9}, 0.5, "most"):
        with pytest.raises(ValueError):
            resample.rows_short(counts, bad)


def test_saved_table_and_splits(spark, acc):
    path = fresh_path(spark, "prepared")
    info = sinks.sink_table(acc, path, T).first()
    assert list(info.final_shape) == [acc.count(), len(acc.columns)]
    assert sinks.read_back(spark, path).exceptAll(acc).count() == 0
    with pytest.raises(ValueError):
        tables.scan_splits(spark, f"{path}/data", T)


def test_single_steps_with_log(acc):
    prep = Preparation(acc)
    prep.transform_datetime()
    prep.handle_missing_values()
    prep.outlier_treatment()
    prep.data_transformation()
    prep.feature_engineering()
    prep.encode_features()
    prep.scale_features()
    steps = [r.step for r in prep.prep_log().collect()]
    assert steps == [
        "data_loading", "datetime", "missing_values", "outlier_treatment", "data_transformation", "feature_engineering",
        "feature_encoding", "feature_scaling",
    ]
    summary = prep.generate_preparation_summary().first()
    assert summary.missing_values_after < summary.missing_values_before and summary.categorical_features == 0
    assert prep.validate_data_quality().count() == 5


@pytest.mark.parametrize("strategy", ["mode_median", "drop", "forward_fill"])
def test_other_imputations(acc, strategy):
    prep = Preparation(acc)
    out = prep.handle_missing_values(strategy)
    assert out.where("num_units is null").count() == 0 or strategy == "forward_fill"


@pytest.mark.parametrize("strategy", ["onehot", "target"])
def test_other_encodings(acc, strategy):
    prep = Preparation(acc.select("event_id", "weather_condition", "num_units", T))
    out = prep.encode_features(strategy)
    assert "weather_condition" not in out.columns and T in out.columns


def test_whole_profile(acc):
    profile = Profile(acc)
    out = profile.run_complete_analysis()
    assert len(profile.insights) >= 8
    assert out["multivariate_analysis"]["risk_slots"].count() > 0
    assert profile.findings().count() == len(profile.insights)
    assert acc.columns == profile.df.columns


def test_inputs_hold_no_injury_columns():
    assert not [c for c in INPUTS if c.startswith("injuries")]


@pytest.mark.parametrize("name", ["cv_scores", "sink_model", "train_and_evaluate"])
def test_queries_train_all_models_as_the_job_does(spark, sf, monkeypatch, name):
    """Stopped where the training would begin."""

    def begin(run, *_):
        raise InterruptedError(run)

    monkeypatch.setattr("gravitas.plans.training.Training.perform_cross_validation", begin)
    monkeypatch.setattr("gravitas.plans.training.Training.train_and_evaluate", begin)
    with pytest.raises(InterruptedError) as stopped:
        catalog.queries()[name](spark, sf)
    found = stopped.value.args[0].estimators
    assert set(found) == {"Logistic Regression", "Decision Tree", "Random Forest"}
    forest = found["Random Forest"]
    assert (forest.getMaxDepth(), forest.getNumTrees(), forest.getWeightCol()) == (models.DEEPEST, models.FOREST_TREES, models.WEIGHT)
