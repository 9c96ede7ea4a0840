"""Paths that small tables would not take by themselves: many groups, several ranges, odd ids, saved models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gravitas.functions.hashing import with_row_id
from gravitas.functions.quantiles import group_quantiles
from gravitas.operators import distributions, encode, impute, metrics, rules, split
from gravitas.sources import sinks, tables


def test_null_scores_are_treated_alike_at_any_size(spark):
    rows = [("m", 0, 0.9, 1, 0), ("m", 0, None, 1, 2), ("m", 0, 0.4, 0, 1), ("m", 0, 0.2, 1, 0), (None, 0, 0.3, 1, 1), (None, 0, None, 1, 0)]
    scores = spark.createDataFrame(rows, "model string, class int, score double, pos long, neg long")
    curves = [
        sorted(map(tuple, metrics.roc_cumulative(scores, ["model"], rows_per_bucket=n).select("model", "score", "tp", "fp").collect()), key=repr)
        for n in (None, 1, 2)
    ]
    assert curves[0] == curves[1] == curves[2] and len(curves[0]) == len(rows)
    areas = [{r["model"]: r["auc"] for r in metrics.roc_auc(scores, ["model"], rows_per_bucket=n).collect()} for n in (None, 1)]
    assert areas[0] == areas[1] and set(areas[0]) == {"m", None}


@pytest.mark.parametrize("per", [None, 500])
def test_quantiles_of_many_groups(spark, per):
    df = spark.range(20_000).select((F.col("id") % 3000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"))
    got = {r["g"]: r["q"] for r in group_quantiles(df, ["x"], [0.25, 0.5], ["g"], per).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile(F.col("x").cast("double"), F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()}
    assert len(got) == 3000
    assert all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g]))


def test_describe_many_groups(spark):
    df = spark.range(8000).select((F.col("id") % 2000).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    got = distributions.boxplot_stats(df, "x", "g").where("g = '7'").first()
    assert (got["count"], got["min"], got["p50"], got["max"]) == (4, 7.0, 3007.0, 6007.0)


def test_repeated_and_null_ids_are_errors(spark):
    same = spark.createDataFrame([(1, "a")] * 12, "id long, t string")
    with pytest.raises(ValueError, match="unique"):
        split.split_stratified(same, "t", "id", leaf_rows=1)
    with pytest.raises(ValueError, match="without an id"):
        split.split_stratified(spark.createDataFrame([(None, "a"), (1, "a")], "id long, t string"), "t", "id")


def test_row_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a")], "x long, y string")
    first, again = ({r["row_id"]: (r["x"], r["y"]) for r in with_row_id(d).collect()} for d in (df, df.repartition(3)))
    assert first == again and len(first) == 4
    parts = split.split_stratified(with_row_id(df.where("y = 'a'")).withColumn("t", F.lit("k")), "t", "row_id")
    assert parts.where("split is null").isEmpty()


def test_codes_of_fitted_values(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), (None, "y"), ("a", "é")], "p string, q string")
    fitted = encode.fit_label(df, ["p", "q"])
    assert fitted.classes() == {"p": 3, "q": 3}
    assert sorted(map(tuple, fitted.transform(df).collect())) == sorted([(1, 0), (0, 3), (2, 0), (3, 1), (0, 2)])


def test_fitted_shares_and_columns_on_other_rows(spark):
    train = spark.createDataFrame([("a", "k"), ("a", "m"), ("b", "k")], "c string, t string")
    test = spark.createDataFrame([("a", "m"), ("z", "m")], "c string, t string")
    shares = encode.fit_target_shares(train, "c", "t", ["k", "m"])
    assert sorted(map(tuple, encode.encode_target(test, "c", "t", ["k", "m"], shares).collect()), key=repr) == sorted([("m", 0.5, 0.5), ("m", None, None)], key=repr)
    wide = encode.onehot(test, "c", encode.fit_onehot(train, "c"))
    assert sorted(map(tuple, wide.collect())) == [("m", 0, 0), ("m", 1, 0)]


def test_fills_for_nulls_that_fitting_has_not_seen(spark):
    train = spark.createDataFrame([(1, "a"), (3, "a"), (5, "b")], "x int, s string")
    later = spark.createDataFrame([(None, None), (2, "b")], "x int, s string")
    filled = impute.fit_auto(train, every=True).transform(later)
    assert sorted(map(tuple, filled.collect())) == [(2, "b"), (3, "a")] and filled.dtypes == later.dtypes


def test_fractional_violations_are_shown(spark):
    df = spark.createDataFrame([(-0.5,), (-2.0,), (1.0,)], "x double")
    assert rules.domain_rules(df, [("x", 0, None, "not negative")]).first()["examples"] == "-2,-0.5"


def test_catalog_of_a_missing_folder(spark, tmp_path):
    assert sinks.model_catalog(spark, str(tmp_path / "none")).count() == 0


def test_same_columns_compares_types(spark):
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([], "x long")
    tables.same_columns(a, a)
    with pytest.raises(ValueError):
        tables.same_columns(a, b)


def test_csv_files_can_be_split(spark, tmp_path):
    """Without line breaks in fields a file is read by many tasks."""
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},x{i}" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = tables.scan_table(spark, str(path), "csv", spark.createDataFrame([], "a int, b string").schema)
        assert df.select(F.spark_partition_id()).distinct().count() > 1 and df.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
