"""Parts that cut work into ranges, prefixes, cells or blocks give the same as doing it in one piece."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gravitas.functions import quantiles
from gravitas.operators import impute, knn, metrics, resample, split


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=120), st.integers(1, 20))
def test_narrowed_quantiles_are_exact(spark, values, limit):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.narrow_quantiles(df, ["x"], probs, limit=limit)[()]["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-9, abs=1e-9)


def test_narrowed_quantiles_per_group(spark):
    rnd = random.Random(1)
    rows = [("a" if rnd.random() < 0.7 else "b", rnd.choice([1.0, 2.0, rnd.gauss(0, 9)]), rnd.random()) for _ in range(3000)]
    rows += [(None, 1.0, None), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = quantiles.narrow_quantiles(df, ["x", "y"], [0.25, 0.5], ["g"], limit=40)
    want = pd.DataFrame([r for r in rows if r[0] in ("a", "b")], columns=["g", "x", "y"]).groupby("g").quantile([0.25, 0.5])
    for g in "ab":
        for c in "xy":
            assert got[(g,)][c] == pytest.approx(list(want.loc[g][c]))
    assert got[("c",)]["x"] == [None, None]
    assert got[(None,)]["x"] == [1.0, 1.0]


def test_both_ways_agree_in_summaries(spark, sf, monkeypatch):
    from gravitas.operators.distributions import describe_numeric

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    direct = describe_numeric(li, ["l_extendedprice"], ["l_returnflag"]).collect()
    monkeypatch.setattr(quantiles, "DISTINCT_LIMIT", 50)
    narrowed = describe_numeric(li, ["l_extendedprice"], ["l_returnflag"]).collect()
    key = lambda r: r.l_returnflag
    for a, b in zip(sorted(direct, key=key), sorted(narrowed, key=key)):
        assert (a.p25, a.p50, a.p75) == pytest.approx((b.p25, b.p50, b.p75))


def test_split_does_not_depend_on_how_far_prefixes_go(acc):
    coarse = split.split_stratified(acc, "most_severe_injury", "event_id")
    fine = split.split_stratified(acc, "most_severe_injury", "event_id", leaf_rows=1)
    assert coarse.select("event_id", "split").exceptAll(fine.select("event_id", "split")).count() == 0


def test_split_shares_per_class(acc):
    rows = split.split_stratified(acc, "most_severe_injury", "event_id").groupBy("most_severe_injury", "split").count().collect()
    sizes: dict = {}
    for r in rows:
        sizes.setdefault(r["most_severe_injury"], {})[r["split"]] = r["count"]
    for per in sizes.values():
        n = sum(per.values())
        assert abs(per["test"] - 0.2 * n) <= 1
        assert abs(per["validation"] - 0.1 * (n - per["test"])) <= 1


def test_split_plan_does_not_shuffle_the_table(acc):
    plan = split.split_stratified(acc, "most_severe_injury", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_folds_differ_by_one_row_at_most(acc):
    rows = split.stratified_folds(acc, "most_severe_injury", "event_id", 5).groupBy("most_severe_injury", "fold").count().collect()
    per: dict = {}
    for r in rows:
        per.setdefault(r[0], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())


def test_forward_fill_over_ranges(acc):
    cols = ["weather_condition", "num_units"]
    df = acc.select("event_id", "crash_day_of_week", *cols)
    whole = impute.impute_ffill(df, cols, "event_id", "event_id", ["crash_day_of_week"])
    cut = impute.impute_ffill(df, cols, "event_id", "event_id", ["crash_day_of_week"], rows_per_bucket=37)
    assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count()


def test_curves_over_ranges(spark, sf):
    from gravitas.plans.model_queries import scores

    table = scores(spark, sf)
    whole = {(r.model, r["class"]): r.auc for r in metrics.roc_auc(table, ["model"]).collect()}
    cut = {(r.model, r["class"]): r.auc for r in metrics.roc_auc(table, ["model"], rows_per_bucket=20).collect()}
    assert whole == pytest.approx(cut)


def points_frame(spark, n, dims, groups, seed, copies):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [float(rnd.randint(0, 6)) for _ in range(dims)]
        rows.append((i, str(rnd.randrange(groups)), vec))
    for j in range(copies):
        rows.append((n + j, "0", [3.0] * dims))
    return rows, spark.createDataFrame(rows, "id long, g string, vec array<double>")


def brute(rows, k):
    out = {}
    for i, g, v in rows:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), j) for j, h, w in rows if h == g and j != i)
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("cell_rows, block", [(2000, 4096), (5, 4096), (40, 7)])
def test_neighbours_are_exact_with_copies_and_ties(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    rows, df = points_frame(spark, 150, 3, 2, 5, copies=75)
    got = {r.id: [(e.dist, e.id) for e in r.neighbours] for r in knn.nearest_neighbours(df, 4, cell_rows=cell_rows).collect()}
    assert got == brute(rows, 4)


def test_neighbours_of_some_rows(spark):
    rows, df = points_frame(spark, 120, 2, 1, 9, copies=10)
    got = {r.id: [(e.dist, e.id) for e in r.neighbours] for r in knn.nearest_neighbours(df, 3, df.where("id % 5 = 0"), 10).collect()}
    want = brute(rows, 3)
    assert got == {i: want[i] for i in want if i % 5 == 0}


@pytest.fixture(scope="module")
def imbalanced(spark):
    rnd = random.Random(3)
    rows = [(i, "big", rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(120)]
    rows += [(1000 + i, "small", rnd.gauss(1, 1), rnd.gauss(1, 1)) for i in range(25)]
    rows += [(2000 + i, "mid", rnd.gauss(-1, 1), rnd.gauss(0, 1)) for i in range(50)]
    return spark.createDataFrame(rows, "id long, t string, x double, y double").cache()


@pytest.mark.parametrize("method", ["smote", "adasyn", "borderline"])
def test_synthetic_rows_lie_between_two_rows_of_their_class(imbalanced, method):
    out = resample.resample(imbalanced, "t", "id", ["x", "y"], method, trace=True)
    rows = {r.id: r for r in imbalanced.collect()}
    kept = [r for r in out.collect() if not r.is_synthetic]
    made = [r for r in out.collect() if r.is_synthetic]
    assert {(r.id, r.t, r.x, r.y) for r in kept} == {(r.id, r.t, r.x, r.y) for r in rows.values()}
    assert made
    for r in made:
        a, b = rows[r.base_id], rows[r.neighbour_id]
        assert a.t == b.t == r.t != "big"
        step = (r.x - a.x) / (b.x - a.x)
        assert 0 <= step <= 1 and r.y == pytest.approx(a.y + step * (b.y - a.y))


def test_smote_fills_every_class_and_repeats(imbalanced):
    first = resample.resample(imbalanced, "t", "id", ["x", "y"])
    again = resample.resample(imbalanced.repartition(7), "t", "id", ["x", "y"])
    assert {r["t"]: r["count"] for r in first.groupBy("t").count().collect()} == {"big": 120, "mid": 120, "small": 120}
    assert first.exceptAll(again).count() == 0


def test_draws_of_one_base_are_spread(imbalanced, monkeypatch):
    whole = resample.resample(imbalanced, "t", "id", ["x", "y"])
    monkeypatch.setattr(resample, "DRAWS_PER_BLOCK", 2)
    assert whole.exceptAll(resample.resample(imbalanced, "t", "id", ["x", "y"])).count() == 0


def test_resampling_refuses_nulls_and_lonely_classes(spark):
    rows = [(i, "a", float(i)) for i in range(20)] + [(99, "b", 1.0)]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    with pytest.raises(ValueError, match="neighbours"):
        resample.resample(df, "t", "id", ["x"])
    with pytest.raises(ValueError, match="nulls"):
        resample.resample(df.withColumn("x", F.when(F.col("id") != 99, F.col("x"))), "t", "id", ["x"])
