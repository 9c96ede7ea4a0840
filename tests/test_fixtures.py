"""Hand-computed cases: ties, nulls, constants, gaps, edges."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gravitas.functions import columns as C
from gravitas.operators import (
    cap, correlation, crosstabs, distributions, encode, features, impute, metrics, outliers, quality, ranking, reshape,
    resample, rules, scale, skew,
)
from gravitas.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def numbers(spark, values):
    return frame(spark, [(None if v is None else float(v),) for v in values], "x double")


def one(df):
    (row,) = df.collect()
    return row


SIX = [1, 2, 2, 3, 3, 10]


def test_mode_takes_the_smallest_on_a_tie(spark):
    assert one(distributions.mode_of(numbers(spark, SIX), "x"))["mode"] == 2


def test_skew_deviation_and_quartiles(spark):
    df = numbers(spark, SIX)
    row = one(distributions.describe_numeric(df, ["x"]))
    assert (row.p25, row.p50) == (2.0, 2.5)
    assert row.std == pytest.approx(3.271085, abs=1e-6)
    assert one(df.agg(C.adjusted_skew(F.col("x")).alias("s"))).s == pytest.approx(2.159962, abs=1e-6)
    assert one(df.agg(F.stddev_pop("x").alias("s"))).s == pytest.approx(2.986079, abs=1e-6)
    assert one(distributions.describe_numeric(numbers(spark, [1, 2, 3, 4]), ["x"])).p25 == 1.75


def test_skew_of_few_or_equal_values(spark):
    assert one(numbers(spark, [1, 2]).agg(C.adjusted_skew(F.col("x")).alias("s"))).s is None
    assert one(numbers(spark, [4, 4, 4]).agg(C.adjusted_skew(F.col("x")).alias("s"))).s == 0


def test_mad_of_zero_leaves_the_column(spark):
    df = numbers(spark, [5, 5, 5, 5, 9])
    assert sorted(r.x for r in cap.fit_cap(df, ["x"], "robust", 3.0).transform(df).collect()) == [5, 5, 5, 5, 9]


def test_clip_keeps_null(spark):
    got = [r.c for r in numbers(spark, [None, 5]).select(C.clip(F.col("x"), 6, 9).alias("c")).collect()]
    assert got == [None, 6.0]


def test_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,NA\n2,NaN\n3,NULL\n4,N/A\n5,None\n6,\n7,2.5\n")
    df = tables.scan_table(spark, str(tmp_path / "t.csv"), "csv")
    assert dict(df.dtypes) == {"a": "bigint", "b": "double"}
    assert [r.b for r in df.orderBy("a").collect()] == [None] * 6 + [2.5]


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.scan_table(spark, str(tmp_path / "absent"), "parquet")
    with pytest.raises(FileNotFoundError):
        tables.scan_resolve(spark, [(str(tmp_path / "absent"), "parquet")])


@pytest.mark.parametrize(
    "rows, want", [([(1, 2), (2, None), (3, 5), (4, 9)], 0.963123), ([(1, 2), (1, 3)], None), ([(1, None), (None, 3)], None)]
)
def test_correlation_with_nulls_and_constants(spark, rows, want):
    df = frame(spark, rows, "a int, b int")
    got = one(correlation.correlation_matrix(df, ["a", "b"])).correlation
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_correlation_far_from_zero(spark):
    rows = [(1e9 + i, 1e9 - 2 * i + (i % 3)) for i in range(50)]
    df = frame(spark, rows, "a double, b double").repartition(5)
    pdf = pd.DataFrame([(a - 1e9, b - 1e9) for a, b in rows])
    assert one(correlation.correlation_matrix(df, ["a", "b"])).correlation == pytest.approx(pdf.corr().iloc[0, 1], abs=1e-9)


def test_label_codes_and_null(spark):
    df = frame(spark, [(i, v) for i, v in enumerate(["b", "a", "b", None, "c"])], "i int, v string")
    fitted = encode.fit_label(df, ["v"])
    assert [r.v for r in fitted.transform(df).orderBy("i").collect()] == [1, 0, 1, 3, 2]
    assert [r.v for r in fitted.transform(df, null_code=-1).orderBy("i").collect()] == [1, 0, 1, -1, 2]
    back = fitted.decode(fitted.transform(df), "v", "w").orderBy("i").collect()
    assert [r.w for r in back] == ["b", "a", "b", None, "c"]


def test_codes_of_many_values_need_no_driver(spark):
    values = spark.range(5000).select(F.lit("x").alias("feature"), F.md5(F.col("id").cast("string")).alias("value"))
    table, sizes = encode.sorted_codes(values)
    got = {r.value: r.code for r in table.collect()}
    assert sizes["x"][0] == 5000
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_histogram_puts_the_largest_in_the_last_bin(spark):
    bins = {r.bin: r.n for r in distributions.histogram_bins(numbers(spark, range(61)), "x").collect()}
    assert len(bins) == 30 and sum(bins.values()) == 61 and bins[30] == 3
    assert {r.bin: r.n for r in distributions.histogram_bins(numbers(spark, [4, 4]), "x").collect()}[1] == 2


def test_crosstab_drops_nulls_and_fills_zeros(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 1), (None, 1)], "a string, b int")
    got = {(r.a, r.b): r.n for r in crosstabs.crosstab_counts(df, "a", "b").collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1, ("b", 2): 0}


def test_mostly_null_and_empty_columns_are_not_imputed(spark):
    df = frame(spark, [(None, None, 1)] * 3 + [("u", None, None)] + [("v", None, 4)], "s string, e string, n int")
    fitted = impute.fit_auto(df)
    assert set(fitted.fills) == {"n"}
    assert set(impute.fit_auto(df, None).fills) == {"s", "n"}
    assert one(fitted.transform(df).agg(F.count("n").alias("n"))).n == 5


def test_median_between_whole_numbers(spark):
    df = frame(spark, [(1,), (2,), (None,)], "n int")
    assert sorted(r.n for r in impute.fit_auto(df).transform(df).collect()) == [1.0, 1.5, 2.0]


def test_absent_day_and_hour_gap(spark):
    df = frame(spark, [(6, 7), (6, 9), (1, 17), (2, 18)], "d int, h int")
    row = distributions.daily_distribution(df, "d").first()
    assert (row.weekend_total, row.weekday_total) == (2, 2)
    rush = one(distributions.rush_hour_totals(df, "h"))
    assert (rush.morning_rush, rush.evening_rush, rush.night) == (2, 2, 0)


def test_single_class(spark):
    df = frame(spark, [(1, "a"), (2, "a")], "x int, t string")
    status = {r["check"]: r.status for r in quality.post_prep_checks(df, "t").collect()}
    assert status["Target Variable"] == "FAIL"
    assert one(distributions.class_imbalance(df, "t")).ratio == 1


def test_post_prep_checks_find_infinity_and_copies(spark):
    df = frame(spark, [(float("inf"), "a"), (1.0, "b"), (1.0, "b"), (None, "b")], "x double, t string")
    status = {r["check"]: (r.status, r.details) for r in quality.post_prep_checks(df, "t", df.schema).collect()}
    assert status["Infinite Values"] == ("FAIL", "infinite cells: 1")
    assert status["Missing Values"] == ("FAIL", "null cells: 1")
    assert status["Duplicate Rows"] == ("WARN", "copies: 1")
    assert status["Data Types"][0] == "PASS"


def test_duplicates_with_nulls(spark):
    df = frame(spark, [(None, math.nan), (None, math.nan), (1, 2.0)], "a int, b double")
    assert one(quality.duplicate_rows(df)).duplicate_rows == 1


def test_balanced_classes_are_not_resampled(spark):
    df = frame(spark, [(i, "a" if i < 19 else "b", float(i)) for i in range(29)], "id long, t string, x double")
    assert resample.resample(df, "t", "id", ["x"]).count() == 29


def test_rank_with_ties(spark):
    df = frame(spark, [("a", 0.9), ("b", 0.9), ("c", 0.5)], "m string, v double")
    got = {r.m: r.p for r in df.withColumn("p", reshape.average_rank(F.col("v"), [])).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_constant_prediction(spark):
    df = frame(spark, [(0, 0), (1, 0), (2, 0)], "a int, p int")
    row = one(metrics.summary(metrics.outcome_counts(df, "a", "p")))
    assert (row.Matthews_Corr, row.Cohen_Kappa) == (0, 0)
    assert row.Balanced_Accuracy == pytest.approx(1 / 3)


def test_accuracy_is_weighted_recall(spark):
    df = spark.range(200).selectExpr("cast(id % 4 as int) a", "cast((id * id) % 4 as int) p")
    row = one(metrics.summary(metrics.outcome_counts(df, "a", "p")))
    assert row.Accuracy == pytest.approx(row.Recall)


def test_confidence_is_strict(spark):
    df = frame(spark, [([0.7, 0.3],), ([0.71, 0.29],), ([0.5, 0.5],)], "p array<double>")
    assert [r.c for r in df.select(metrics.confidence(F.col("p")).alias("c")).collect()] == ["Medium", "High", "Low"]


def test_injury_rate_with_a_total_of_minus_one(spark):
    df = frame(spark, [(-1, 1, 0), (-1, 0, 0), (1, 1, 1), (None, 1, 1)], "t int, a int, b int")
    rates = [r.injury_rate for r in features.injury_features(df, "t", ["a", "b"], ["a"]).collect()]
    assert rates == [math.inf, None, 1.0, None]


def test_unknown_hour_is_night_period(spark):
    row = one(features.time_flags(frame(spark, [(None,)], "h int"), "h"))
    assert (row.is_night, row.time_period) == (0, 3)


def test_iqr_bounds_and_flags(spark):
    df = numbers(spark, [*range(10), 100])
    row = one(outliers.outlier_iqr_summary(df, ["x"]))
    assert (row.outliers, row.max_outlier) == (1, 100)
    flags = one(outliers.outlier_flags(outliers.outlier_iqr_summary(df, ["x"])))
    assert flags.cap_or_transform and flags.investigate and flags.is_worst


def test_zscore_needs_a_column_without_nulls(spark):
    values = [0.0] * 30 + [100.0]
    assert set(cap.fit_cap(numbers(spark, values), ["x"], "zscore", 3.0).bounds) == {"x"}
    assert cap.fit_cap(numbers(spark, [*values, None]), ["x"], "zscore", 3.0).bounds == {}
    with pytest.raises(ValueError):
        cap.fit_cap(numbers(spark, values), ["x"], "other")


def test_rules_show_the_smallest_wrong_values(spark):
    df = frame(spark, [(h,) for h in [24, 24, 30, 25, 26, 27, 28, 5, None]], "h int")
    row = one(rules.domain_rules(df, [("h", 0, 23, "hour")]))
    assert (row.invalid_count, row.status, row.examples) == (7, "FAIL", "24,25,26,27,28")
    assert one(rules.domain_rules(df, [("h", 0, None, "hour")])).status == "PASS"


def test_scaled_columns(spark):
    df = frame(spark, [(float(i), i % 2, 3.0) for i in range(8)], "x double, b int, c double")
    cols = scale.scalable(df, ["x", "b", "c"])
    assert cols == ["x", "c"]
    out = scale.fit_scale(df, cols).transform(df)
    row = one(out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("c").alias("c")))
    assert (round(row.m, 9), round(row.s, 9), row.c) == (0.0, 1.0, 0.0)
    low, high = one(scale.fit_scale(df, ["x"], "minmax").transform(df).agg(F.min("x"), F.max("x")))
    assert (low, high) == (0.0, 1.0)


def test_log_columns(spark):
    df = numbers(spark, [0, 0, 0, 0, 0, 0, 0, 0, 0, 50])
    assert skew.skewed_columns(df, ["x"]) == ["x"]
    assert skew.skewed_columns(numbers(spark, [-1, 0, 0, 0, 0, 0, 50]), ["x"]) == []


def test_advice_and_best_model_on_ties(spark):
    rows = [("B", 0.9, 1.0), ("A", 0.9, 2.0), ("C", 0.5, 0.1)]
    df = frame(spark, rows, "Model string, F1_Score double, Training_Time double")
    assert one(ranking.select_best_model(df)).Model == "A"
    advice = one(ranking.model_advice(df))
    assert (advice.similar, advice.weak, advice.most_efficient) == (False, False, "C")
    with pytest.raises(ValueError):
        ranking.select_best_model(df, "Other")


def test_shared_folder_comes_from_the_session(spark):
    from gravitas.session import fresh_path, shared_dir

    named = shared_dir(spark)
    assert fresh_path(spark, "x").startswith(named + "/x-")
    assert shared_dir(spark) == named


def test_unpivot_transpose_round(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k string, x double, y double")
    got = {r.metric: (r.a, r.b) for r in reshape.transpose(df, "k", ["x", "y"], ["a", "b"]).collect()}
    assert got == {"x": (1.0, 3.0), "y": (2.0, 4.0)}
