"""What the review of round 4 found: names that differ by case, deep forests on many rows."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from gravitas.operators import forest, models
from gravitas.plans import catalog
from gravitas.plans.model_queries import model_rows
from gravitas.plans.prepare import prepare_splits
from gravitas.plans.training import Training
from gravitas.session import fresh_path

COLUMNS = ["a", "A", "N", "R"]


def test_columns_that_differ_by_case_are_written(spark, tmp_path):
    """The table is written and read by name; the caller's session, its settings taken over, stays as it was."""
    lines = [(1, "A"), (1, "A"), (1, "R"), (2, "N"), (2, None), (None, "A")]
    spark.createDataFrame(lines, "l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    was = spark.conf.get("spark.sql.caseSensitive")
    table = catalog.queries()["crosstab_wide"](spark, str(tmp_path))
    assert table.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    table.write.parquet(str(tmp_path / "wide"))
    found = pq.read_table(tmp_path / "wide").to_pydict()
    assert list(found) == COLUMNS and sorted(zip(*found.values())) == [(1, 2, 0, 1), (2, 0, 1, 0)]
    assert sorted(map(tuple, table.select("A", "a").collect())) == [(0, 2), (2, 1)]
    assert spark.conf.get("spark.sql.caseSensitive") == was


def noisy(spark, rows: int):
    """Rows of three classes that follow in part from the features, one of them with many values; one part of a file."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 12, rows), rng.integers(0, 2, rows), rng.normal(size=rows), rng.integers(0, 7, rows)], axis=1).astype(float)
    score = x[:, 0] / 4 + x[:, 2] + x[:, 1] * x[:, 3] / 3 + rng.normal(size=rows)
    lines = [(i, "abc"[int(s > 1.5) + int(s > 3.5)], *map(float, r)) for i, (s, r) in enumerate(zip(score, x))]
    return spark.createDataFrame(lines, "event_id long, kind string, p double, q double, r double, s double").coalesce(1)


def prepared(spark, rows: int = 3000):
    return models.prepare(noisy(spark, rows), "kind", ["p", "q", "r", "s"])


def forest_of(ready, trees: int, depth: int):
    return models.define_models(ready.n_rows, models.Profile(forest_trees=trees, forest_depth=depth))["Random Forest"]


def test_tree_in_arrays_is_the_tree_of_mllib(spark, monkeypatch):
    """All features tried in each node and rows weighted by their draws: the same splits, pruned alike. Deeper down
    several splits are equally good and either may be taken."""
    monkeypatch.setattr(forest, "features_of", lambda rng, nodes, settings: np.tile(np.arange(4), (nodes, 1)))
    rng = np.random.default_rng(3)
    cuts = [np.arange(b - 1) + 0.5 for b in (9, 2, 30, 5)]
    x = np.stack([rng.integers(0, len(c) + 1, 1500) for c in cuts]).astype(np.uint8)
    y = ((x[0] / 3 + x[2] / 10 + rng.normal(size=1500)).clip(0, 5) / 2).astype(np.uint8)
    n = rng.poisson(1.0, 1500) + 1
    weights = np.array([0.7, 1.3, 2.9])
    settings = forest.Settings(cuts, weights, len(cuts), 4, 1, 1)
    tree = forest.pruned(forest.grow(x, y, n.astype(np.uint8), settings, 4, rng), weights)
    lines = [(float(c), float(weights[c] * k), *map(float, r)) for c, k, r in zip(y, n, x.T)]
    data = models.assembler(["a", "b", "c", "d"]).transform(spark.createDataFrame(lines, f"{models.LABEL} double, w double, a double, b double, c double, d double"))
    want = DecisionTreeClassifier(maxDepth=4, maxBins=64, labelCol=models.LABEL, featuresCol=models.FEATURES, weightCol="w").fit(data)
    assert len(tree.feature) == want.numNodes > 15
    w = tree.counts * weights
    got = (w / w.sum(axis=1, keepdims=True))[forest.descend(tree, x)]
    assert np.allclose(got, [r["probability"] for r in models.scored(want, data).collect()])
    assert np.allclose(forest.importance(tree, settings), want.featureImportances.toArray())


@pytest.mark.parametrize("local", [1000, 100_000])
def test_forest_grown_on_many_rows(spark, monkeypatch, local):
    """In levels or at once: sums of counts hold, the same rows give the same forest, and MLlib's model scores alike."""
    monkeypatch.setattr(forest, "GROWN_FROM", 1000)
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 700)
    monkeypatch.setattr(forest, "PASS_NODES", 11)
    monkeypatch.setattr(forest, "CELLS", 300)
    ready = prepared(spark)
    est = forest_of(ready, 6, 30)
    grown = models.fit_model(ready, ready.frame, est)
    trees = [forest.Nodes.unpacked(r, 3) for r in grown.table.orderBy("tree").collect()]
    assert len(trees) == 6 and len({t.gain.sum() for t in trees}) == 6
    for t in trees:
        inner = t.feature >= 0
        assert np.array_equal(t.counts[inner], t.counts[t.child[inner]] + t.counts[t.child[inner] + 1])
        assert (t.counts.sum(axis=1) > 0).all() and (t.gain[inner] > 0).all() and 2800 < t.counts[0].sum() < 3200
    again = models.fit_model(ready, ready.frame, est)
    assert again.sizes == grown.sizes and np.array_equal(again.shares, grown.shares)
    held = models.assembler(ready.features).transform(ready.indexer.transform(noisy(spark, 5000).where("event_id >= 3000")))
    scored = models.scored(grown, held)
    assert sorted(map(repr, scored.collect())) == sorted(map(repr, models.scored(grown.mllib, held).collect()))
    monkeypatch.setattr(forest, "SCORED_NODES", 2 * max(grown.sizes))
    assert 1 < len(grown.groups()) < 6 and sorted(map(repr, models.scored(grown, held).collect())) == sorted(map(repr, scored.collect()))
    assert np.allclose(grown.mllib.featureImportances.toArray(), grown.featureImportances.toArray())
    usual = est.fit(ready.frame)
    assert 0.8 < grown.totalNumNodes / usual.totalNumNodes < 1.25 and max(t.depth for t in grown.mllib.trees) > 12
    right = [m.agg(F.avg((F.col("prediction") == F.col(models.LABEL)).cast("int"))).first()[0] for m in (scored, models.scored(usual, held))]
    assert abs(right[0] - right[1]) < 0.04


def test_thresholds_follow_all_rows(spark):
    """Between all values of few, else at even weight."""
    ready = prepared(spark, 4000)
    weights = np.array([r["w"] for r in ready.frame.groupBy(models.LABEL).agg(F.first(models.WEIGHT).alias("w")).orderBy(models.LABEL).collect()])
    cuts = forest.find_cuts(forest.arrays(ready.frame, forest_of(ready, 2, 2)), weights, 64)
    assert [len(c) for c in cuts] == [11, 1, 63, 6] and cuts[1].tolist() == [0.5] and cuts[0][0] == 0.5
    r = np.array([x["r"] for x in noisy(spark, 4000).collect()])
    share = np.bincount(np.searchsorted(cuts[2], r, "left"), minlength=64) / 4000
    assert share.max() < 3 / 64


def test_other_forests_are_left_to_mllib(spark, monkeypatch):
    ready = prepared(spark)
    est = forest_of(ready, 2, 2)
    assert not forest.can_grow(est, ready.n_rows, 3) and forest.can_grow(est, forest.GROWN_FROM + 1, 3)
    assert not forest.can_grow(est.copy({est.impurity: "entropy"}), 10**6, 3) and not forest.can_grow(DecisionTreeClassifier(), 10**6, 3)
    monkeypatch.setattr(forest, "GROWN_FROM", 1000)
    uneven = ready.frame.withColumn(models.WEIGHT, F.rand(1) + 0.5)
    assert forest.grow_forest(est, uneven, 3) is None and not isinstance(models.fit_model(ready, uneven, est), forest.GrownForest)


def test_training_grows_its_forests(spark, sf, monkeypatch):
    """Fits, folds, search, importances and the saved model come without MLlib's fit; results are scored once."""

    def never(*_):
        raise AssertionError("fitted by MLlib")

    monkeypatch.setattr(forest, "GROWN_FROM", 100)
    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    done = prepare_splits(model_rows(spark, sf))
    run = Training(done.parts["train"], done.parts["test"], done.fitted.features, "most_severe_injury", done.parts["validation"])
    run.define_models(models.Profile(tree_depth=3, forest_trees=4, forest_depth=30), ["Decision Tree", "Random Forest"])
    results = run.train_and_evaluate()
    assert "Scan parquet" not in results._jdf.queryExecution().executedPlan().toString() and results.count() == 2
    assert run.predictions.where("Model = 'Random Forest'").count() == done.parts["test"].count()
    shares = {r["Model"]: r["s"] for r in models.feature_importance(spark, run.trained, run.features).groupBy("Model").agg(F.sum("Importance").alias("s")).collect()}
    assert shares["Random Forest"] == pytest.approx(1.0)
    assert {r["Model"] for r in run.perform_cross_validation("event_id", 2).collect()} == {"Decision Tree", "Random Forest"}
    tuned = run.tune_hyperparameters("event_id", {"Random Forest": [{"maxDepth": 2, "numTrees": 2}, {"maxDepth": 4, "numTrees": 3}]}, 2).collect()
    assert len(tuned) == 2 and sum(r["is_best"] for r in tuned) == 1
    run.results = run.results.where("Model like 'Random%'")
    saved = run.save_best_model(fresh_path(spark, "models")).first()
    assert saved.model_type == "RandomForestClassificationModel" and saved.feature_count == len(run.features)
