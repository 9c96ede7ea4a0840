"""Parts whose tables of classes, cells, ranges or keys grow with the data give the same as the plain way."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gravitas.functions.hashing import order_key
from gravitas.operators import correlation, crosstabs, encode, impute, knn, metrics, models, reshape, split


def test_neighbours_through_a_tree_of_cells(spark, monkeypatch):
    """Several levels of cells; the pairs compared stay far below all pairs."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(0, 60, (40, 3))
    points = centres[rnd.integers(0, 40, 2400)] + rnd.normal(0, 1, (2400, 3))
    df = spark.createDataFrame([(i, "g", [float(x) for x in p]) for i, p in enumerate(points)], "id long, g string, vec array<double>")
    compared, plain = [], knn._blocks

    def counting(queries, members, k):
        cells = members.groupBy("g", "cell").agg(F.count("*").alias("m"))
        compared.append(queries.groupBy("g", "cell").agg(F.count("*").alias("n")).join(cells, ["g", "cell"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0])
        return plain(queries, members, k)

    monkeypatch.setattr(knn, "_blocks", counting)
    monkeypatch.setattr(knn, "FANOUT", 8)
    got = {r.id: [e.id for e in r.neighbours] for r in knn.nearest_neighbours(df, 5, cell_rows=20).collect()}
    for i in range(0, 2400, 7):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        assert got[i] == [int(j) for j in np.lexsort((np.arange(2400), d)) if j != i][:5]
    assert sum(compared) < 2400 * 2400 / 10


def test_neighbours_move_once_per_block(spark, monkeypatch):
    """Where no cell can be closed a vector goes to each block, not to each cell; blocks far apart do not meet."""
    rnd = np.random.default_rng(6)
    spread = rnd.normal(0, 1, (600, 16))
    apart = np.repeat(np.arange(4), 150)[:, None] * 1000.0 + rnd.normal(0, 1, (600, 16))
    rows = [(i, g, [float(x) for x in p]) for g, points, at in (("spread", spread, 0), ("apart", apart, 600)) for i, p in enumerate(points, at)]
    met, plain = [], knn.block_pairs

    def seen(placed, asked):
        pairs = plain(placed, asked)
        met.extend(asked.join(pairs, ["g", "block", "part"]).groupBy("g").agg(F.count("*").alias("n")).collect())
        return pairs

    monkeypatch.setattr(knn, "block_pairs", seen)
    monkeypatch.setattr(knn, "SEARCH_ROWS", 200)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(knn, "FANOUT", 8)
    df = spark.createDataFrame(rows, "id long, g string, vec array<double>")
    got = {r.id: [e.id for e in r.neighbours] for r in knn.nearest_neighbours(df, 5, cell_rows=20).collect()}
    for points, at in ((spread, 0), (apart, 600)):
        for i in range(600):
            d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
            assert got[at + i] == [int(j) + at for j in np.lexsort((np.arange(600), d)) if j != i][:5]
    moved = {r.g: r.n for r in met}
    assert moved["spread"] <= 600 * 4 and moved["apart"] < moved["spread"]


def test_splits_of_very_many_classes(spark):
    df = spark.range(300_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("t"))
    place = F.row_number().over(Window.partitionBy("t").orderBy(order_key(F.col("id"), 42)))
    n = F.count("*").over(Window.partitionBy("t"))
    test = F.floor(n * 0.2 + 0.5)
    val = test + F.floor((n - test) * 0.1 + 0.5)
    want = df.select("id", F.when(place <= test, "test").when(place <= val, "validation").otherwise("train").alias("split"))
    got = split.split_stratified(df, "t", "id").select("id", "split")
    assert got.exceptAll(want).isEmpty() and got.count() == 300_000


@pytest.mark.parametrize("leaf", [1, 7])
def test_folds_along_prefixes(spark, leaf):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, "small").alias("t"))
    place = F.row_number().over(Window.partitionBy("t").orderBy(order_key(F.col("id"), 42)))
    n = F.count("*").over(Window.partitionBy("t"))
    fold = F.when(place <= F.floor(n / 3), 0).when(place <= F.floor(2 * n / 3), 1).otherwise(2)
    want = df.select("id", F.when(F.col("t").isNotNull(), fold).alias("fold"))
    assert split.stratified_folds(df, "t", "id", 3, leaf_rows=leaf).select("id", "fold").exceptAll(want).isEmpty()


def test_moments_merge_to_a_row_per_pair(spark):
    rnd = random.Random(2)
    rows = [(1e9 + rnd.gauss(0, 1), rnd.gauss(5, 2) if rnd.random() < 0.9 else None, 7.25, float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(37)
    few = correlation.merged_moments(df, ["a", "b", "c", "d"], mergers=3)
    assert few.count() == 6 and few.where("a = 0 and b = 3").first().n == 4000
    got = {(r.feature_1, r.feature_2): r.correlation for r in correlation.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    both = np.array([(r[0], r[1]) for r in rows if r[1] is not None])
    assert got["a", "b"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-6)
    assert got["a", "c"] is None and got["c", "d"] is None
    assert got["a", "d"] == pytest.approx(np.corrcoef([r[0] for r in rows], [r[3] for r in rows])[0, 1], abs=1e-6)


@pytest.mark.parametrize("per", [None, 50])
def test_curves_without_needless_points(spark, per):
    rnd = random.Random(6)
    rows = [("m", 0, i / 2000, int(y), 1 - int(y)) for i in range(2000) for y in [rnd.random() < i / 2000]]
    scores = spark.createDataFrame(rows, "model string, class int, score double, pos long, neg long")
    every = sorted((r.fpr, r.tpr) for r in metrics.roc_points(scores, ["model"], per, thinned=False).collect())
    some = sorted((r.fpr, r.tpr) for r in metrics.roc_points(scores, ["model"], per).collect())
    area = lambda p: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:]))
    assert len(every) == 2001 and len(some) < 0.7 * len(every) and set(some) < set(every)
    assert area(some) == pytest.approx(area(every))


def test_forward_fill_where_all_rows_have_one_time(spark):
    rows = [(i, 5, "k" if i % 3 else None, float(i) if i % 7 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, t long, k string, x double").repartition(5)
    whole = impute.impute_ffill(df, ["x"], "t", "id", ["k"])
    cut = impute.impute_ffill(df, ["x"], "t", "id", ["k"], rows_per_bucket=60)
    assert whole.exceptAll(cut).isEmpty() and cut.count() == 1000
    last = {}
    want = {}
    for i, _, k, x in rows:
        last[k] = x if x is not None else last.get(k)
        want[i] = last[k]
    assert {r.id: r.x for r in cut.collect()} == want


def test_grids_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(reshape, "PAIR_BLOCK", 4)
    df = spark.range(400).select((F.col("id") % 23).alias("x"), (F.col("id") * 7 % 31).alias("y"))
    got = {(r.a, r.b): r.n for r in crosstabs.crosstab_counts(df, "x", "y").collect()}
    assert len(got) == 23 * 31 and sum(got.values()) == 400
    top = crosstabs.top_rows_crosstab(df, "x", "y", 2)
    assert top.count() == 2 * 31 and all(got[r.a, r.b] == r.n for r in top.collect())


def test_sparse_counts_of_very_many_values(spark):
    df = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).alias("y"))
    assert crosstabs.pair_counts(df, "x", "y").agg(F.sum("n")).first()[0] == 300_000
    assert crosstabs.top_rows_crosstab(df.where("y < 500"), "x", "y", 3).count() <= 1500


@pytest.mark.parametrize("limit", [None, 0])
def test_shares_where_one_category_has_half_the_rows(spark, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(encode, "BROADCAST_BYTES", limit)
    rows = [("hot" if i % 2 else (None if i % 10 == 0 else f"c{i % 900}"), "k" if i % 3 else "m") for i in range(6000)]
    df = spark.createDataFrame(rows, "c string, t string")
    per = {}
    for c, t in rows:
        per.setdefault(c, []).append(t == "k")
    got = encode.encode_target(df, "c", "t", ["k", "m"]).groupBy("c_share_0").count().collect()
    want = {}
    for v in per.values():
        share = round(sum(v) / len(v), 9)
        want[share] = want.get(share, 0) + len(v)
    assert {round(r.c_share_0, 9): r["count"] for r in got} == want


def test_weights_follow_from_the_rows_of_a_fold(spark):
    rows = [(i, "a" if i % 5 else "b", float(i % 11), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t string, x double, fold int")
    ready = models.prepare(df, "t", ["x"])
    for i, (part, held) in enumerate(models.fold_parts(ready, ready.frame, 3)):
        facts = part.frame.agg(F.sum(models.WEIGHT).alias("w"), F.count("*").alias("n")).first()
        assert facts.n == part.n_rows == 300 - held.count() and facts.w == pytest.approx(facts.n)
        sums = [r.s for r in part.frame.groupBy("t").agg(F.sum(models.WEIGHT).alias("s")).collect()]
        assert sums == pytest.approx([part.n_rows / 2] * 2)
